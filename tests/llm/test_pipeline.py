import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as C  # noqa: E402
from test_decontam import brute as contaminated  # noqa: E402
from test_neardup import brute as components  # noqa: E402
from weftgraph.llm import pii  # noqa: E402
from weftgraph.llm.queries import tokenizer_path  # noqa: E402


def test_against_brute_force(spark, make_docs):
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(20), say(30)]
    texts = [say(rng.randint(5, 60)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[2] + " end"] + [f"{say(8)} {it} {say(9)}" for it in items]
    texts += [f"{say(9)} a.b@c.org {say(4)} +1 (555) 123-4567 {say(3)}", None, "", "12 34", say(20) + " card: 4111 1111 1111 1111", "é <|endoftext|> x"]
    docs, d = make_docs(texts, langs=["en"] * len(texts))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    left = [i for i, t in enumerate(texts) if t and any(ch.isalpha() for ch in t)]
    _, label = components([texts[i] for i in left])
    left = [i for k, i in enumerate(left) if label[k] == k]
    bad = {i for i, _ in contaminated([texts[i] for i in left], items)}
    left = [i for k, i in enumerate(left) if k not in bad]
    lib = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i in left:
        t = pii.redact(texts[i], pii.find_spans(texts[i]))
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (t, len(t), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.text, r.n_chars, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, d).collect()}
    assert got == want
    assert "a.b@c.org" not in str(got) and "4111 1111" not in str(got)


def test_stages_keep_columns_and_stand_empty_tables(spark, make_docs):
    _, d = make_docs([], extra={"kept": "boolean"})
    spark.createDataFrame([(1, "some item text of a test here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() == 0
    assert C.run(spark, d).count() == 0


def test_columns_of_any_name_and_long_texts(spark, make_docs):
    long = "é word " * 200_000
    texts = ["some words of a text here", None, long, "12 34", long.replace("word", "WORD")]
    own = {c: "double" for c in ("score", "lang_pred", "held_out", "n", "id", "key", "component_id", "kept", "similarity", "spans", "n_tokens", "ids_sha256")}
    docs, d = make_docs(texts, langs=["en"] * 5, extra=own)
    docs = docs.select(*[F.lit(0.25).alias(c) if c in own else F.col(c) for c in docs.columns])
    spark.createDataFrame([(1, "some item text of a test here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert set(own) < set(docs.columns) and {r[c] for r in docs.collect() for c in own} == {0.25}
    out = C.tokens(spark, docs, d)
    assert len(set(out.columns)) == len(out.columns)
    assert {r.doc_id: (r.n_chars, r.score) for r in out.collect()} == {0: (25, 0.25), 2: (1_400_000, 0.25)}
    lib = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {i: len(lib.encode(texts[i]).ids) for i in (0, 2)}


def test_repeated_rows_and_missing_ids(spark, make_docs):
    docs, d = make_docs(["a b c d e f", "a b c d e f", "g h i j k l", None], ids=[4, 4, None, 5])
    assert sorted((r.doc_id or 0, r.text or "") for r in C.near_duplicates(spark, docs, d).collect()) == [(0, "g h i j k l"), (4, "a b c d e f"), (5, "")]
