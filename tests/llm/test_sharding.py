import math
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from weftgraph.llm import sharding
from weftgraph.llm.queries import op8_hypergeometric_sharding as op8


def test_matrix_sums():
    m = sharding.communication_matrix([5, 0, 9, 3], [6, 5, 6], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 3] and m.sum(axis=0).tolist() == [6, 5, 6] and m.min() >= 0
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 1)


def chi_square(seen, chances, draws):
    """(statistic, degrees of freedom), cells of few expected draws put together."""
    total, freedom, s, e = 0.0, -1, 0, 0.0
    for k, p in sorted(chances.items()):
        s, e = s + seen.get(k, 0), e + p * draws
        if e >= 8:
            total, freedom, s, e = total + (s - e) ** 2 / e, freedom + 1, 0, 0.0
    return total, max(1, freedom)


@pytest.mark.parametrize("good, bad, n", [(7, 5, 6), (40, 60, 25), (3, 500, 90), (500, 3, 90), (900, 900, 300), (2000, 300, 2200)])
def test_ratio_of_uniforms_has_the_exact_law(good, bad, n):
    rng, draws = np.random.default_rng(good + n), 20_000
    seen = Counter(sharding.ratio_of_uniforms(rng, good, bad, n) for _ in range(draws))
    chances = {k: comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    assert set(seen) <= set(chances)
    total, freedom = chi_square(seen, chances, draws)
    assert total < freedom + 5 * (2 * freedom) ** 0.5


def test_draws_from_large_populations():
    rng = np.random.default_rng(3)
    good, bad, n = 3 * 10**12, 5 * 10**12, 10**7
    x = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(4000)])
    spread = (n * (3 / 8) * (5 / 8)) ** 0.5
    assert abs(x.mean() - n * 3 / 8) < 4 * spread / 4000**0.5 and 0.95 < x.std() / spread < 1.05
    assert abs(np.mean(np.abs(x - n * 3 / 8) < spread) - 0.6827) < 0.03
    assert sharding._hypergeometric(rng, 0, 5, 3) == 0 and sharding.ratio_of_uniforms(rng, 2 * 10**9, 0, 5) == 5
    # steps of factorials against exact integers
    for a, d in ((250, -40), (10**6, 1000), (10**9, -(10**4)), (10**13, 10**6)):
        parts = range(a + 1, a + d + 1) if d > 0 else range(a + d + 1, a + 1)
        exact = sum(math.log1p((i - a - 0.5) / (a + 0.5)) for i in parts) * (1 if d > 0 else -1)
        assert abs(sharding._log_factorial_step(a, d) - exact) < 1e-6 * max(1, abs(exact))


def test_shards_and_slots_are_even(spark):
    """Neighbours by id, and rows of one block, fall into shards and slots as chance has it."""
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = sharding.hypergeometric_shards(df, ["doc_id"], shards=8, rows_per_block=10).collect()
    even = dict.fromkeys(range(8), 1 / 8)
    both = Counter((r.doc_id // 2500, r.shard) for r in rows)
    total = sum((both[a, b] - 312.5) ** 2 / 312.5 for a in range(8) for b in range(8))
    assert total < 49 + 5 * 98**0.5
    order = sorted(rows, key=lambda r: r.doc_id)
    far = Counter((b.shard - a.shard) % 8 for a, b in zip(order, order[1:]))
    total, freedom = chi_square(far, even, len(order) - 1)
    assert total < freedom + 5 * (2 * freedom) ** 0.5
    thirds = Counter((r.doc_id * 4 // 20_000, r.slot * 4 // 2500) for r in rows)
    assert sum((thirds[a, b] - 1250) ** 2 / 1250 for a in range(4) for b in range(4)) < 9 + 5 * 18**0.5


def test_exact_sizes_and_slots(spark, make_docs):
    texts = ["same"] * 300 + [None, "", "é" * 50_000] + [f"t{i}" for i in range(200)]
    _, d = make_docs(texts, extra={"shard": "string", "slot": "string"})
    rows = op8(spark, d).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(range(len(texts)))
    by = defaultdict(list)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert set(by) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    n = [len(s) for s in by.values()]
    assert max(n) - min(n) <= 1
    assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, op8(spark, d).collect()), key=str)


def test_repeated_rows_nulls_and_empty(spark, make_docs):
    _, d = make_docs(["a", "a", "b"], ids=[1, 1, None])
    rows = op8(spark, d).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, None: 1}
    _, d = make_docs([])
    assert op8(spark, d).collect() == []


def test_text_columns_travel(spark, make_docs):
    df, _ = make_docs([f"text {i}" for i in range(50)], extra={"slot": "string"})
    out = sharding.hypergeometric_shards(df, ["doc_id"], shards=3)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, f"text {i}") for i in range(50)}
