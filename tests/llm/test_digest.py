import hashlib
import math
import random
from collections import Counter

import numpy as np

from weftgraph.llm import digest as D
from weftgraph.llm.queries import op10_fingerprints as op10


def entropy(window):
    n = len(window)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(window).values()) / n


def brute_features(t):
    """Hashes of the chosen windows in order of place, by plain loops: windows of 8, stretches of 8, two votes."""
    if len(t) < 8:
        return [int(D._hashes(np.frombuffer(t, np.uint8), len(t))[0])] if t else []
    windows = [t[i : i + 8] for i in range(len(t) - 7)]
    ranks = []
    for w in windows:
        rarity = min(1000, int(abs(round(entropy(w) * 65536) - 2.7 * 65536) * 1000 // int(1.8 * 65536)))
        ranks.append((-rarity, int(D._hashes(np.frombuffer(w, np.uint8), 8)[0]) >> 11))
    votes = Counter()
    for i in range(max(1, len(windows) - 7)):
        votes[min(ranks[i : i + 8])] += 1
    enough = min(2, max(votes.values()))
    return [(1000 + r) << 53 | h for r, h in dict.fromkeys(ranks) if votes[r, h] >= enough]


def text(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


DEGENERATE = ["a" * 5000, "b" * 5000, "ab" * 3000, "xyz " * 3000, "x " * 200, "=" * 300, "-" * 300, "0123456789abcdef" * 40, "tiny", "é"]


def test_entropies_and_features():
    rng = random.Random(2)
    odd = [text(rng, 60), text(rng, 5), "é漢 " * 60, *DEGENERATE]
    for t in [x.encode() for x in odd] + [bytes(range(256)) * 2, *(bytes(range(97, 97 + n)) for n in (1, 7, 8, 9, 26))]:
        if len(t) >= 8:
            ent = D.window_entropies(np.frombuffer(t, np.uint8)) / 65536
            assert np.allclose(ent, [entropy(t[i : i + 8]) for i in range(len(t) - 7)], atol=1e-3)
        got = D.features([t])[0].tolist()
        want = brute_features(t)
        assert len(got) == len(set(got)) and len(got) > 0
        same = len(set(got) & set(want))  # entropies are rounded differently, which may turn a rank by one
        assert same >= 0.9 * max(len(got), len(want)), t[:40]


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(6)
    t = text(rng, 4000).encode()
    whole = D.features([t])[0].tolist()
    for size in (64, 100, 1000):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        assert D.features([t[:3], t, b""])[1].tolist() == whole


def test_no_cliffs_and_no_false_twins():
    rng = random.Random(7)
    sk = lambda t: D.filters(D.features([t.encode()])[0])
    for n in (60, 100, *range(118, 142), 255, 256):
        t = text(rng, 80)[:n]
        near = D.likeness(sk(t), sk(t[:-1] + "q"))
        assert near > 0.6, (n, near)
    made = [sk(t) for t in DEGENERATE]
    for i, a in enumerate(made):
        assert len(a[1])
        for j, b in enumerate(made):
            assert (D.likeness(a, b) == 1.0) == (i == j) and (i == j or D.likeness(a, b) < 0.9), (i, j)


def test_likeness_in_blocks(monkeypatch):
    rng = random.Random(9)
    a, b = text(rng, 20_000), text(rng, 9000)
    x, y = (D.filters(D.features([t.encode()])[0]) for t in (a + b, b[:20_000] + a))
    whole = D.likeness(x, y)
    monkeypatch.setattr(D, "PAIRS", 7)
    assert abs(D.likeness(x, y) - whole) < 1e-12 and 0 < whole < 1


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [text(rng, rng.randint(0, 200)).encode() for _ in range(40)] + [b"", b"x", b"a" * 500]
    alone = [D.features([t])[0].tolist() for t in texts]
    assert [f.tolist() for f in D.features(texts)] == alone


def test_likeness():
    rng = random.Random(4)
    sk = lambda t: D.filters(D.features([t.encode()])[0])
    a, b = text(rng, 3000), text(rng, 3000)
    assert D.likeness(sk(a), sk(a)) == 1.0 and D.likeness(sk(""), sk("")) == 1.0 and D.likeness(sk(""), sk(a)) == 0.0
    assert D.likeness(sk(a), sk(b)) < 0.1
    small = D.likeness(sk(a), sk(a[: len(a) // 2] + b[: len(a) // 2]))
    large = D.likeness(sk(a), sk(a[:-50]))
    assert 0.2 < small < large
    back = D.parse(D.fingerprint(sk(a)))
    assert np.array_equal(back[0], sk(a)[0]) and back[1].tolist() == sk(a)[1].tolist()


def test_query(spark, make_docs):
    rng = random.Random(5)
    texts = [text(rng, rng.choice([1, 5, 40, 300])) for _ in range(60)] + [None, "", "é" * 9, "tiny", "x " * 40_000]
    texts += [texts[3]] * 4
    ids = rng.sample(range(10_000), len(texts))
    _, d = make_docs(texts, ids=ids, extra={"fingerprint": "int", "part": "string"})
    rows = op10(spark, d).orderBy("doc_id").collect()
    by = dict(zip(ids, texts))
    assert [r.doc_id for r in rows] == sorted(ids)
    seen = {}
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, f = by[r.doc_id] or "", by[nxt.doc_id] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + f[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), r.doc_id
        made = [D.filters(D.features([x.encode()])[0]) for x in (t, edited, f)]
        assert r.fingerprint == D.fingerprint(made[0]) and r.edited_fingerprint == D.fingerprint(made[1])
        assert abs(r.near_edited - D.likeness(made[0], made[1])) < 1e-12
        assert abs(r.near_next - D.likeness(made[0], made[2])) < 1e-12
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint


def test_repeats_null_ids_and_empty(spark, make_docs):
    _, d = make_docs(["a", "a", "b", None], ids=[1, 1, None, None])
    assert Counter(r.doc_id for r in op10(spark, d).collect()) == {1: 2, None: 2}
    _, d = make_docs([])
    assert op10(spark, d).count() == 0
    _, d = make_docs(["abcd"])
    assert op10(spark, d).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_bounds(spark):
    for n in (1, 2, 3, 10, 57):
        bounds = [3 * i for i in range(n)]
        ids = [*range(-2, 3 * n + 3), None]
        df = spark.createDataFrame([(i,) for i in ids], "id long")
        got = {r[0]: r[1] for r in df.select("id", D._bounds_up_to(df["id"], bounds)).collect()}
        assert got == {i: None if i is None else sum(b <= i for b in bounds) for i in ids}
