import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from weftgraph.llm import bpe, token_files, transducer  # noqa: E402
from weftgraph.llm.queries import op1_token_files as op1  # noqa: E402
from weftgraph.llm.queries import op2_bpe as op2  # noqa: E402
from weftgraph.llm.queries import op6_token_counts as op6  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
ODD = [
    "'s", "'re x", "a's's", "", " ", "  a", "\n\n a", "a \n b", "'ll'", "' s", " 's", "''s", "<|endoftext|>",
    "a <|endoftext|> b<|endoftext|>", "x　y  z", "漢字かな 한국어", "😀 😀😀", "١٢٣", "a​b", "\x1c\x1d a",
    "don't we'll I'm", "..'s", "1's", "\n's", " \n's", "<|endoftext|", "\x00", "�", "a" * 5000, " " * 3000 + "x", "é" * 3000,
]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    pieces = [*"abst'rel 12\n\t.!é漢 ", "<|endoftext|>", "'ll", " ", "\x85", "\x1f", "²", "Ⅷ", "the", " ing", "Ᲊ", "\U00010d4a"]
    return ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def cut(flat, n):
    ends = np.cumsum(n)
    return [flat[s:e].tolist() for s, e in zip(ends - n, ends)]


@pytest.mark.parametrize("make", [bpe.encoder, token_files.library_encoder])
def test_encoders_match_the_library(make, texts, lib):
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert cut(*make(PATH).encode(texts)) == want
    small = make(PATH)
    small.table.limit, kept = 50, small.table.limit  # emptied again and again
    try:
        assert [cut(*small.encode([t]))[0] for t in texts[:300]] == want[:300]
    finally:
        small.table.limit = kept


def test_decode_matches_the_library(texts, lib):
    for t in texts[:400]:
        ids = np.array(lib.encode(t, add_special_tokens=False).ids, np.int64)
        assert bpe.bpe_decode(ids, PATH) == lib.decode(ids.tolist(), skip_special_tokens=False)
    broken = np.array([ids for ids in range(188, 256)])  # single bytes that are no characters
    assert bpe.bpe_decode(broken, PATH) == lib.decode(broken.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("chunk", [3, 50, transducer.CHUNK_BYTES])
def test_transducer_counts(chunk, texts, lib):
    plain = [t for t in texts if "<|endoftext|>" not in t]
    want = [len(e.ids) for e in lib.encode_batch(plain, add_special_tokens=False)]
    machine = transducer.transducer(PATH)
    assert machine.counts([t.encode() for t in plain], chunk).tolist() == want


def unbroken(kind, n, seed=5):
    """Long texts without blanks, in which no place tells the state by itself."""
    rng = random.Random(seed)
    letters = {
        "cjk": "漢字仮名交文章例中国人大地天水火山川日月",
        "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "words": None,
        "one": "a",
        "two": "ab",
        "blank": " ",
        "accents": "éàüßñ",
        "digits": "0123456789",
        "quotes": "'s",
        "thai": "กขคงจฉชซ",
    }[kind]
    if letters is None:
        return "".join(rng.choice(["the", "ing", "house", "red", "Able", "tion"]) for _ in range(n // 4))
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("kind", ["cjk", "base64", "words", "one", "two", "blank", "accents", "digits", "quotes", "thai"])
def test_transducer_on_texts_without_landmarks(kind, lib):
    machine = transducer.transducer(PATH)
    texts = [unbroken(kind, n) for n in (1, 700, 5000, 20_000)]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    for chunk, block in ((64, 3000), (768, 10**6), (7, 10**6)):
        assert machine.counts([t.encode() for t in texts], chunk, block).tolist() == want, (chunk, block)


def test_scan_of_maps():
    rng = np.random.default_rng(4)
    n, k = 60, 4
    goes, adds = rng.integers(-1, k, (n, k)), rng.integers(0, 9, (n, k))
    goes[rng.random(n) < 0.7] = np.abs(goes[rng.random(n) < 0.7][0])
    first = rng.random(n) < 0.1
    first[0] = True
    at, total = transducer.scan(goes, adds, first)
    state = here = 0
    for c in range(n):
        if first[c]:
            state = here = 0
        if state >= 0:
            here += adds[c, state]
            state = goes[c, state]
        assert at[c] == state and (state < 0 or total[c] == here)


def test_transducer_starts_anew(lib):
    machine = transducer.CountTransducer(bpe.vocabulary(PATH), state_limit=5)
    for t in ("hello world", "other words", "'tis  1999!"):
        assert machine.counts([t.encode()]).tolist() == [len(lib.encode(t).ids)]


def test_queries(spark, make_docs, lib, texts):
    docs = [None, *ODD, "same text"] + ["same text"] * 3 + texts[100:160]
    order = list(range(len(docs)))
    random.Random(1).shuffle(order)
    _, d = make_docs([docs[i] for i in order], ids=[3 * i for i in order], extra={"ids": "string", "start": "int"})
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in docs]
    got1, start = {r.doc_id: r for r in op1(spark, d).collect()}, 0
    got2 = {r.doc_id: r for r in op2(spark, d).collect()}
    got6 = {r.doc_id: r for r in op6(spark, d).collect()}
    for i, ids in enumerate(want):
        t = docs[i] or ""
        a, b, c = got1[3 * i], got2[3 * i], got6[3 * i]
        own = np.array([*ids, 2], "<u4")
        assert (a.start, a.n_tokens, a.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
        assert (b.n_tokens, b.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert b.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len(t.encode()), len(ids), len(ids) > 1024)


def test_empty_and_repeated(spark, make_docs):
    _, d = make_docs([])
    assert [q(spark, d).count() for q in (op1, op2, op6)] == [0, 0, 0]
    _, d = make_docs(["b", "a", "a"], ids=[None, 1, 1])
    assert sorted((r.start, r.n_tokens) for r in op1(spark, d).collect()) == [(0, 2), (2, 2), (4, 2)]


def test_file_format(spark, make_docs, tmp_path):
    df, _ = make_docs([f"text number {i} " * 20 for i in range(3000)])
    out = str(tmp_path / "tokens")
    token_files.write_token_files(df.coalesce(1), PATH, out, end_id=2, page_rows=100)
    file = next((tmp_path / "tokens").glob("part-*.parquet"))
    meta = pq.ParquetFile(file).metadata
    for k in range(meta.num_columns):
        col = meta.row_group(0).column(k)
        assert col.has_offset_index and col.has_column_index
        assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(col.encodings)
    some = token_files.read_ids(spark, out, 10, 12).collect()
    assert sorted(r.doc_id for r in some) == [10, 11, 12]
    plan = token_files.read_ids(spark, out, 10, 12)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in plan
    assert "ids" not in token_files.read_metadata(spark, out).columns
