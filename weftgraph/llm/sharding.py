"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows fall into P blocks by hash. How many rows each block sends to each of B bins (a bin is a
shard's stretch of slots) is drawn exactly: row p of the matrix is multivariate hypergeometric
on the room that the bins still have. Then every block permutes its rows locally and deals them
out by its row of the matrix (first exchange), and every bin permutes what it received (second
exchange). Only DataFrame functions touch the rows; the driver holds P counts and the matrix,
at most 2048 x 2048 integers whatever the input.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks counted in the first pass; the blocks in use are a power of two up to this.
FINE_BLOCKS = 2048
#: numpy's sampler refuses larger populations; from there on ratio_of_uniforms draws.
NUMPY_LIMIT = 1_000_000_000


def _log_factorial_step(n: int, d: int) -> float:
    """log((n + d)! / n!) - d * log(n + 1/2), without the cancellation that large logarithms of factorials have."""
    if min(n, n + d) < 200:
        said = math.lgamma(n + d + 1) - math.lgamma(n + 1)
        return said - d * math.log(n + 0.5)
    # Gosper's and Stirling's series about n + 1/2: log n! = (x log x - x) + c - 1 / (24 x) + 7 / (2880 x**3), x = n + 1/2
    x = n + 0.5
    y = x + d
    return y * math.log1p(d / x) - d - (1 / y - 1 / x) / 24 + 7 * (y**-3 - x**-3) / 2880


def ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw (Stadlober, 1990) for populations of any size, to double precision.

    A point falls uniformly into a rectangle that holds the region u**2 <= p(a + v / u) / p(mode); what lies in the region is
    kept. Probabilities relative to the mode are sums of four steps of factorials, whose large parts cancel exactly.
    """
    total = good + bad
    if n == 0 or good == 0 or bad == 0 or n == total:
        return 0 if good == 0 else min(n, good)
    low, high = max(0, n - bad), min(n, good)
    mode = ((n + 1) * (good + 1)) // (total + 2)
    mean = n * good / total
    var = mean * (bad / total) * ((total - n) / max(1, total - 1))
    width = math.sqrt(8 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    bases = (mode, good - mode, n - mode, bad - n + mode)
    slope = math.log(((good - mode + 0.5) / (mode + 0.5)) * ((n - mode + 0.5) / (bad - n + mode + 0.5)))
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not low <= k <= high:
            continue
        d = k - mode
        shifts = (d, -d, -d, d)
        log_p = d * slope - sum(_log_factorial_step(b, s) for b, s in zip(bases, shifts))
        if 2 * math.log(u) <= log_p:
            return k


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if max(good, bad) < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    return ratio_of_uniforms(rng, good, bad, n)


def communication_matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """counts[p] rows of block p over the bins: row sums are counts, column sums capacities."""
    if sum(counts) != sum(capacities):
        raise ValueError("counts and capacities differ in their sums")
    rng = np.random.default_rng(seed)
    room = np.array(capacities, np.int64)
    matrix = np.zeros((len(counts), len(capacities)), np.int64)
    for p, n in enumerate(counts):
        if int(room.sum()) < NUMPY_LIMIT:
            row = rng.multivariate_hypergeometric(room, n, method="marginals")
        else:
            row, left, rest = np.zeros(len(room), np.int64), n, int(room.sum())
            for b, here in enumerate(room.tolist()):
                rest -= here
                row[b] = _hypergeometric(rng, here, rest, left)
                left -= int(row[b])
        matrix[p] = row
        room = room - row
    return matrix


def _near_equal(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def hypergeometric_shards(
    df: DataFrame, keys: list[str], shards: int = 16, seed: int = 20_240_901, rows_per_block: int = 1_000_000
) -> DataFrame:
    """df plus `shard` and `slot`: a uniform permutation cut into shards whose counts differ by at most one.

    keys name the columns that tell rows apart; blocks and permutations come from their seeded hashes,
    so a task that runs again gives the same rows. Rows equal in all keys are interchangeable.
    Nulls in keys hash like any value; long texts are hashed whole. An empty table gives no rows. Columns of df named shard or
    slot are replaced. Slots of a shard are gapless from 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    block, bin_, draw, rank = "__weft_block", "__weft_bin", "__weft_draw", "__weft_rank"
    own = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*own)
    hashed = lambda k: F.xxhash64(F.lit(seed + k), *[F.col(c) for c in keys])
    fine = F.pmod(hashed(1), F.lit(FINE_BLOCKS)).cast("int")
    found = dict(df.groupBy(fine.alias(block)).count().collect())
    total = sum(found.values())
    blocks = 256
    while blocks < FINE_BLOCKS and total > blocks * rows_per_block:
        blocks *= 2
    counts = [sum(found.get(i, 0) for i in range(p, FINE_BLOCKS, blocks)) for p in range(blocks)]
    each = max(1, math.ceil(blocks / shards))
    capacities, first = [], []
    for n in _near_equal(total, shards):
        offset = 0
        for m in _near_equal(n, each):
            capacities.append(m)
            first.append(offset)
            offset += m
    matrix = communication_matrix(counts, capacities, seed)
    ends = np.cumsum(matrix, axis=1)
    # The matrix as a literal table: a row for each block, with the ends of its stretch for each bin.
    # Every step-th end goes beside them, so that a row looks its bin up in two short lists.
    step = max(1, math.isqrt(ends.shape[1]))
    said = [f'{{"p":{p},"e":{row.tolist()},"c":{row[step - 1 :: step].tolist()}}}'.replace(" ", "") for p, row in enumerate(ends)]
    cells = "[" + ",".join(said) + "]"
    deal = spark.range(1).select(F.explode(F.from_json(F.lit(cells), "array<struct<p:int,e:array<bigint>,c:array<bigint>>>")).alias("x"))
    deal = deal.select(F.col("x.p").alias(block), F.col("x.e").alias("__weft_ends"), F.col("x.c").alias("__weft_coarse"))
    firsts = F.array(*[F.lit(x).cast("long") for x in first])

    local = W.partitionBy(block).orderBy(draw, *keys)
    ranked = (
        df.withColumns({block: F.pmod(fine, F.lit(blocks)), draw: hashed(2)})
        .withColumn(rank, F.row_number().over(local) - 1)
        .join(F.broadcast(deal), block)  # at most FINE_BLOCKS rows of FINE_BLOCKS longs
    )
    whole = f"size(filter(__weft_coarse, e -> e <= {rank})) * {step}"
    fine_part = f"size(filter(slice(__weft_ends, __weft_whole + 1, {step}), e -> e <= {rank}))"
    dealt = ranked.withColumn("__weft_whole", F.expr(whole)).withColumn(bin_, F.expr(f"__weft_whole + {fine_part}"))
    again = W.partitionBy(bin_).orderBy(draw, *keys)
    return (
        dealt.withColumn(draw, hashed(3))
        .withColumn(rank, F.row_number().over(again) - 1)
        .select(
            *own,
            F.floor(F.col(bin_) / F.lit(each)).cast("int").alias("shard"),
            (F.get(firsts, F.col(bin_)) + F.col(rank)).cast("long").alias("slot"),
        )
    )
