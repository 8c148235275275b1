import random
import re
from collections import defaultdict

import numpy as np

from weftgraph.llm import common, neardup
from weftgraph.llm import shingles as S
from weftgraph.llm.components import connected_components
from weftgraph.llm.queries import op7_near_duplicates as op7


def brute_set(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = [brute_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for x in s for j in seen[x]}
        for j in near:
            k = len(s & sets[j])
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                label[b] = a
        for x in s:
            seen[x].append(i)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def corpus(seed, group, others):
    """A large group of near copies with growing edits, chains of copies, and unrelated texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return words

    base = say(120)
    out = [" ".join(edited(base, rng.randint(0, 7))) for _ in range(group)]
    chain = say(100)
    for _ in range(25):
        chain = edited(chain, 2)
        out.append(" ".join(chain))
    for _ in range(others):
        t = say(rng.choice([1, 3, 4, 5, 6, 9, 30, 80, 400]))
        out += [" ".join(t)] * rng.choice([1, 1, 2]) + [" \n".join(edited(t, 1)).upper()]
    passage = say(40)
    out += [" ".join(say(rng.randint(5, 60)) + passage) for _ in range(150)]
    out += [None, "", " \t\n", "é É", "é É", "a\x0bb c d e f", "a b c d e f"]
    rng.shuffle(out)
    return out


def check(spark, d, texts):
    n, label = brute(texts)
    got = {r.doc_id: r for r in op7(spark, d).collect()}
    assert len(got) == len(texts)
    wrong = [i for i in range(len(texts)) if (got[i].n_shingles, got[i].component_id) != (n[i], label[i])]
    assert not wrong, [(i, got[i], n[i], label[i]) for i in wrong[:5]]
    assert all(got[i].kept == (label[i] == i) for i in got)


def test_against_brute_force(spark, make_docs):
    texts = corpus(3, 300, 150)
    _, d = make_docs(texts, extra={"n": "int", "component_id": "string"})
    check(spark, d, texts)


def test_hot_keys_and_large_buckets(spark, make_docs, monkeypatch):
    """Hot classes, centres, labels and shingles are dealt into parts; buckets beyond a few members take the prefix filter."""
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    monkeypatch.setattr(common, "HOT_PARTS", 20)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = [" ".join(base)] * 60
    texts += [" ".join(base[:k] + [f"x{k}", f"y{rng.random()}"] + base[k + 2 :]) for k in range(2, 56) for _ in range(3)]
    texts += [" ".join(base[:45] + [f"z{k}-{i}" for i in range(9)]) for k in range(30)]
    texts += ["word " * 300_000 + "end", "word " * 290_000 + "end"]
    rng.shuffle(texts)
    docs, _ = make_docs(texts)
    n, label = brute(texts)
    got = {r.doc_id: r for r in neardup.near_duplicate_components(docs, small_bucket=4).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(n, label))


def test_nulls_and_empty(spark, make_docs):
    _, d = make_docs(["a b c d e f", "a b c d e f", "a b c d e f"], ids=[None, 7, 7])
    got = sorted(map(tuple, op7(spark, d).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True)], key=str)
    # one document in two classes joins them
    _, d = make_docs(["a b c", "a b c", "d e f", "d e f", "g h"], ids=[4, 9, 9, 6, 9])
    assert {(r.doc_id, r.component_id) for r in op7(spark, d).collect()} == {(4, 4), (9, 4), (6, 4)}
    _, d = make_docs([])
    assert op7(spark, d).count() == 0


def test_registers_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for size in (4, 20, 200, 3000):
        share = []
        for _ in range(120):
            u = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
            k = max(1, round(size * 0.125))
            a, b = u[k:], np.delete(u, np.arange(len(u) - k, len(u)))
            true = (len(u) - 2 * k) / len(u)
            agree = (S.hyperminhash(a) == S.hyperminhash(b)).sum()
            share.append(S.corrected_jaccard(np.array(agree), np.array(len(a)), np.array(len(b))) - true)
        assert abs(np.mean(share)) < 0.05, size


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5), (None, 3)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
