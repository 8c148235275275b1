import itertools
import random
import re

import numpy as np
import pytest

from weftgraph.llm import common
from weftgraph.llm import decontam as D
from weftgraph.llm.queries import op3_decontamination as op3


def brute_stretch(equal, share):
    best = (0, 0, 0)
    for i in range(len(equal)):
        for j in range(i, len(equal)):
            k = int(sum(equal[i : j + 1]))
            if equal[i] and equal[j] and k >= share * (j - i + 1) - 1e-9 and j - i + 1 > best[1]:
                best = (i, j - i + 1, k)
    return best


def test_best_stretch():
    rng = np.random.default_rng(4)
    for _ in range(400):
        e = rng.random(rng.integers(0, 40)) < rng.choice([0.3, 0.7, 0.9])
        assert D.best_stretch(e) == brute_stretch(e, D.MIN_SHARE), e


def words(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())


def brute(texts, items):
    """Every alignment of every text with every item of three words and more."""
    out = set()
    for d, t in enumerate(texts):
        w = words(t)
        for k, item in enumerate(items):
            v = words(item)
            if len(v) < 3:
                continue
            for shift in range(1 - len(v), len(w)):
                low, high = max(0, shift), min(len(w), shift + len(v))
                e = np.array([w[p] == v[p - shift] for p in range(low, high)], bool)
                whole = high - low == len(v) and 5 * e.sum() >= 4 * len(v)
                if whole or (e.sum() >= 10 and D.best_stretch(e)[1] >= 13):
                    out.add((d, k))
    return out


def corpus(rng):
    vocab = [f"w{i}é"[: rng.randint(2, 5)] + str(i) for i in range(300)] + ["the", "of"] * 60
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [" ".join(say(n)) for n in (3, 4, 5, 6, 8, 12, 16, 30, 60)] + ["too short", "", None]
    texts = []
    for it in items[:9]:
        v = it.split()
        for edits in (0, 1, 2, 3):
            for lo, hi in ((0, len(v)), (0, 14), (len(v) // 3, len(v))):
                part = v[lo:hi]
                for _ in range(edits):
                    part[rng.randrange(len(part))] = "zz"
                texts.append(" ".join(say(rng.randint(0, 30))) + " " + ", ".join(part).upper() + ". " + " ".join(say(rng.randint(0, 30))))
    texts += [" ".join(say(200)) for _ in range(20)] + [None, "", "too short"]
    return texts, items


def test_against_all_alignments(spark, make_docs, tmp_path):
    texts, items = corpus(random.Random(8))
    docs, d = make_docs(texts + texts[:1], extra={"item_id": "string"})
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bench.write.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op3(spark, d).collect()}
    want = brute(texts + texts[:1], [x or "" for x in items])
    assert got <= want
    # a seed needs six equal words under some mask: with one substitution none is missed, nor are whole short items
    assert {(i, k) for i, k in want if (texts + texts[:1])[i].lower().count("zz") <= 1 or len(words(items[k])) < 13} <= got
    assert len(got) >= 0.95 * len(want)
    rest = D.decontaminate(docs, bench)
    assert rest.columns == docs.columns
    assert {r.doc_id for r in rest.collect()} == set(range(len(texts) + 1)) - {i for i, _ in got}


@pytest.mark.parametrize("n", [0, 3])
def test_empty_tables(spark, make_docs, n):
    docs, _ = make_docs(["some words that stand here for a test"] * n)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).count() == 0
    assert D.decontaminate(docs, none).count() == n


def test_hot_passages_and_a_full_bitmap(spark, make_docs, monkeypatch):
    """One passage in most texts, one item in many copies, and a bitmap that lets every seed through."""
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    monkeypatch.setattr(common, "HOT_PARTS", 10)
    rng = random.Random(2)
    say = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    items = [say(16), say(5), say(9)]
    texts = [f"{say(5)} {items[0]} {say(5)}" for _ in range(150)] + [say(40) for _ in range(20)] + [f"{say(100_000)} {items[2]}", None]
    docs, _ = make_docs(texts)
    bench = spark.createDataFrame([(i % 3, t) for i, t in enumerate(items * 2)], "item_id long, text string")
    want = sorted([(i, 0) for i in range(150)] + [(170, 2)])
    for most in (D.MOST_BITS, 7):
        monkeypatch.setattr(D, "LEAST_BITS", min(7, most))
        monkeypatch.setattr(D, "MOST_BITS", most)
        got = D.contamination(docs, bench).collect()
        assert sorted({(r.doc_id, r.item_id) for r in got}) == want and len(got) == 2 * len(want)
        assert {(r.start_word, r.n_words, r.similarity) for r in got if r.doc_id < 150 and r.n_words == 16} == {(5, 16, 1.0)}


def test_share_of_substitutions_that_leave_a_seed():
    """All ways to substitute a fifth of 13 to 16 words, first and last word equal: how many leave a mask untouched."""
    for n in range(13, 17):
        met = total = 0
        for gone in itertools.combinations(range(1, n - 1), n // 5):
            total += 1
            met += any(not any(m[g - a] == "1" for g in gone if a <= g < a + len(m)) for m in D.MASKS for a in range(n - len(m) + 1))
        assert met >= 0.985 * total, n
