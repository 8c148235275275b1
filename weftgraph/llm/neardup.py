"""Near-duplicate groups by HyperMinHash bands, corrected Jaccard estimates and exact set verification.

Exact copies collapse to classes first. Class representatives put their bands of compressed registers into buckets.
Links are sought in steps, each among what the steps before left apart, so that what is passed on is close to a
spanning forest and not every pair of a group:

1. Each bucket has a centre, its member with the most company in all its buckets. Each document meets the centre that
   it shares most buckets with.
2. Documents that are still in different components and share a bucket of up to SMALL_BUCKET members meet, and so do a
   larger bucket's members and its centre.
3. What is still apart from the centre of a large bucket goes through an exact prefix filter over shingles, so work does
   not grow with the square of a bucket and no link is lost.

Proposed pairs pass the estimate, then are confirmed on their full shingle sets. A shingle is its 64-bit hash there: two
different shingles of a pair of texts with n of them together are taken for one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import shingles as S
from weftgraph.llm.common import blocks_of, bound_batches, hot_keys, remove_path, salted_join, written
from weftgraph.llm.components import connected_components

SMALL_BUCKET = 48
#: Standard errors below the threshold at which an estimate still lets a pair through.
SIGMAS = 5.0
#: Shingles in a batch of rows sent on by a worker.
ELEMENT_ROWS = 200_000


def _bytes(batch: pa.RecordBatch, k: int) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(k).cast(pa.binary())]


def _signatures(df: DataFrame) -> DataFrame:
    """id, text -> id, n, cls (digest of the whole set), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, regs = [], [], []
            for s in S.shingle_sets(_bytes(b, 1)):
                n.append(len(s))
                cls.append(hashlib.md5(s.tobytes()).digest())
                regs.append(S.hyperminhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "cls", "regs"]
            )

    return df.select("id", "text").mapInArrow(run, "id long, n long, cls binary, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """id, key: a row for each band of registers; the key is a hash of the band's number and its registers."""
    width = 2 * S.ROWS
    keys = f"transform(sequence(0, {S.BANDS - 1}), i -> xxhash64(i, substring(regs, {width} * i + 1, {width})))"
    return reps.select("id", F.explode(F.expr(keys)).alias("key"))


def _sets(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.tobytes() for s in S.shingle_sets(_bytes(b, 1))], pa.binary())], ["id", "elements"]
            )

    return df.select("id", "text").mapInArrow(run, "id long, elements binary")


def _attached(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """a, b of pairs (a written table), then one's columns of b and of a, named with _b and _a. one has a column id."""
    side = lambda c: one.select(*[F.col(x).alias(c if x == "id" else f"{x}_{c}") for x in one.columns])
    total = pairs.count()
    hot_a, hot_b = (hot_keys(pairs.groupBy(c).count(), total) for c in ("a", "b"))
    return salted_join(salted_join(pairs, side("b"), "b", "a", hot_b), side("a"), "a", "b", hot_a)


def _promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose corrected estimate does not speak against it."""
    near = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            x, y = (np.frombuffer(b"".join(_bytes(b, k)), np.uint16).reshape(-1, S.REGISTERS) for k in (4, 5))
            estimate = S.corrected_jaccard((x == y).sum(axis=1), n, m)
            spread = np.sqrt(near * (1 - near) * (1 / S.REGISTERS + 1 / np.minimum(n, m)))
            keep = pa.array(estimate >= near - SIGMAS * spread)
            yield b.select(["a", "b"]).filter(keep)

    joined = _attached(pairs, reps.select("id", "n", "regs"))
    joined = joined.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. pairs and sets are written tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(_bytes(b, 2), _bytes(b, 3)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _attached(pairs, sets).select("a", "b", "elements_a", "elements_b").mapInArrow(run, "a long, b long").distinct()


def _elements(sets: DataFrame) -> DataFrame:
    """id, n, x: a row for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            own = [np.frombuffer(s, np.int64) for s in _bytes(b, 1)]
            for lo, hi in blocks_of([len(s) for s in own], ELEMENT_ROWS):
                n = np.array([len(s) for s in own[lo:hi]])
                columns = [np.repeat(ids[lo:hi], n), np.repeat(n, n), np.concatenate(own[lo:hi])]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["id", "n", "x"])

    return sets.select("id", "elements").mapInArrow(run, "id long, n long, x long")


class _Tables:
    """Written tables of one computation."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        table, path = written(frame, f"neardup-{name}")
        self.paths.append(path)
        return table

    def components(self, links: DataFrame) -> DataFrame:
        return connected_components(links, made=self.paths)

    def drop(self) -> None:
        for path in self.paths:
            remove_path(self.spark, path)


def near_duplicate_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, small_bucket: int = SMALL_BUCKET
) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable over links), kept (the row is that document).

    Two rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of five-word shingles; equal non-empty
    sets are always linked. A null or wordless text has no shingles and stands alone. A row with a null id is linked
    with nothing: component_id null, kept true. Rows that repeat an id are one document: links of each are links of all.
    Texts are read whole, however long: a text of n bytes takes about 30 n bytes while its set is made, 8 a shingle after.
    Ties of centres go to the smaller id and change no result. ids are long; other columns are left out, so their names
    may be any. An empty table gives no rows. The result is a table in the shared folder; what led to it is removed.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = _Tables(spark)

    sig = made.keep(_signatures(docs), "sig")
    real = sig.where("n > 0 and id is not null")
    reps = real.groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("n").alias("copies"))
    reps = made.keep(reps, "reps")
    again = made.keep(real.groupBy("id").count().where("count > 1").select("id"), "repeated")
    repeated = not again.isEmpty()
    total = reps.count()

    bands = _bands(reps)
    buckets = bands.groupBy("key").agg(F.count("id").alias("size")).where("size > 1")
    buckets = made.keep(buckets, "buckets")
    hot = hot_keys(buckets.select("key", "size"), total)
    met = salted_join(bands, buckets, "key", "id", hot)
    company = W.partitionBy("id")  # BANDS rows at most, more only where ids repeat
    met = made.keep(met.select("id", "key", "size", F.sum("size").over(company).alias("score")), "met")
    centre = met.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("c"))
    centre = centre.select("key", F.col("c.score").alias("rank"), (-F.col("c.minus")).alias("p"))
    stars = salted_join(met.select("id", "key", "size"), centre, "key", "id", hot).where("id <> p")
    stars = made.keep(stars, "stars")
    wanted = made.keep(met.select("id").distinct(), "wanted")
    sets = _sets(docs.join(wanted, "id", "left_semi"))
    sets = made.keep(sets.dropDuplicates(["id", "elements"]) if repeated else sets, "sets")

    def linked(pairs: DataFrame, step: str) -> DataFrame:
        tried = made.keep(pairs, f"{step}-pairs")
        promising = made.keep(_promising(tried, reps, percent), f"{step}-promising")
        return made.keep(_confirmed(promising, sets, percent), f"{step}-links")

    # 1. Everyone and the centre that it shares most buckets with.
    shared = stars.groupBy("id", "p").agg(F.count("key").alias("votes"), F.max("rank").alias("rank"))
    best = shared.groupBy("id").agg(F.max(F.struct("votes", "rank", (-F.col("p")).alias("minus"))).alias("c"))
    first = best.select((-F.col("c.minus")).alias("a"), F.col("id").alias("b"))
    links = linked(first, "first")
    if repeated:
        same = real.join(again, "id", "left_semi").select("id", "cls").join(reps.select(F.col("id").alias("b"), "cls"), "cls")
        links = made.keep(links.union(same.where("id <> b").select(F.col("id").alias("a"), "b")).distinct(), "same-links")
    parts = made.components(links)

    # 2. Members of small buckets, and large buckets' members and centres, that are in different components.
    label = lambda frame, c: frame.join(parts.select(F.col("id").alias(c), F.col("component").alias(f"l_{c}")), c, "left")
    small = label(met.where(F.col("size") <= small_bucket), "id").select("key", F.coalesce("l_id", "id").alias("l"), "id")
    apart = small.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("l", "id"))).alias("xs")).where("xs[0].l <> element_at(xs, -1).l")
    pairs = apart.select("xs", F.explode("xs").alias("x")).select(
        F.col("x.id").alias("x"), F.explode(F.expr("filter(xs, y -> y.l > x.l)")).alias("y")
    )
    pairs = pairs.select(F.least("x", "y.id").alias("a"), F.greatest("x", "y.id").alias("b"))
    large = label(stars.where(F.col("size") > small_bucket).select(F.col("p").alias("a"), F.col("id").alias("b")).distinct(), "b")
    centres = stars.where(F.col("size") > small_bucket).select(F.col("p").alias("a")).distinct()
    centres = label(centres, "a").select("a", F.coalesce("l_a", "a").alias("l_a"))
    large = made.keep(large.select("a", "b", F.coalesce("l_b", "b").alias("l_b")), "large")
    to_centre = salted_join(large, centres, "a", "b", hot_keys(large.groupBy("a").count(), large.count()))
    pairs = pairs.union(to_centre.where("l_a <> l_b").select(F.least("a", "b"), F.greatest("a", "b")))
    more = linked(pairs.distinct(), "second")
    if not more.isEmpty():
        links = made.keep(links.union(more), "links")
        parts = made.components(links)

    # 3. Large buckets whose members are not all with their centre yet.
    still = label(large.select("a", "b"), "b").select("a", "b", F.coalesce("l_b", "b").alias("l_b"))
    still = made.keep(still, "still")
    centres = label(centres.select("a"), "a").select("a", F.coalesce("l_a", "a").alias("l_a"))
    still = salted_join(still, centres, "a", "b", hot_keys(still.groupBy("a").count(), still.count())).where("l_a <> l_b")
    still = made.keep(still.select(F.col("b").alias("id"), F.lit(True).alias("open")).distinct(), "open")
    if not still.isEmpty():
        members = label(met.where(F.col("size") > small_bucket).select("id").distinct(), "id")
        members = members.join(still, "id", "left")
        members = members.select("id", F.coalesce("l_id", "id").alias("l"), F.coalesce("open", F.lit(False)).alias("open"))
        rest = _rest_pairs(made.keep(members, "members"), sets, percent, made)
        links = made.keep(links.union(linked(rest, "rest")), "all-links")
        parts = made.components(links)

    by_class = reps.join(parts, "id", "left").select("cls", F.coalesce("component", "id").alias("component_id"))
    classes = hot_keys(reps.select("cls", "copies"), sig.count())
    out = salted_join(sig.drop("regs"), by_class, "cls", "id", classes, "left")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    alone = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(alone)
    result, _ = written(
        out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id")), "neardup-result"
    )
    made.drop()
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id, with all columns; rows without id stay.

    Of rows that repeat both id and text one stays; rows of that id with other texts stay too. Null, empty and very long
    texts, ties, empty tables and other columns as in near_duplicate_components.
    """
    found = near_duplicate_components(df, id_col, text_col, percent)
    gone, _ = written(found.where("not kept").select(id_col).distinct(), "neardup-gone")
    again, _ = written(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "neardup-again")
    left = df.join(gone, id_col, "left_anti").select(*df.columns)
    if again.isEmpty():
        return left
    once = left.join(again, id_col, "left_anti").select(*df.columns)
    return once.unionByName(left.join(again, id_col, "left_semi").select(*df.columns).dropDuplicates([id_col, text_col]))


def _rest_pairs(members: DataFrame, sets: DataFrame, percent: int, made: _Tables) -> DataFrame:
    """members (id, l, open) -> every pair a, b of an open one and one of another component l that may be linked.

    Let s be how many of a document's n shingles some other member has. A link to one of m shingles needs an
    intersection of at least percent / (100 + percent) * (n + m), and of at least percent / 100 * n, so a document
    with a smaller s has no link here. With shingles in order of frequency, two documents whose intersection is at
    least o share one among the first n - o + 1 of either. What only one document has comes first and is counted, not
    sent.
    """
    least = f"cast(ceil({percent} * n / 100) as long)"
    rows = made.keep(_elements(sets.join(members, "id", "left_semi")), "elements")
    df = made.keep(rows.groupBy("x").agg(F.count("id").alias("df")).where("df > 1"), "frequencies")
    hot = hot_keys(df.select("x", "df"), rows.count())
    shared = made.keep(salted_join(rows, df, "x", "id", hot), "shared")
    able = shared.groupBy("id", "n").agg(F.count("x").alias("s")).where(f"s >= {least}").drop("n").join(members, "id")
    order = W.partitionBy("id").orderBy("df", "x")
    ranked = shared.join(able, "id").withColumn("at", F.row_number().over(order) + F.col("n") - F.col("s"))
    prefix = made.keep(ranked.where(f"at <= n - {least} + 1").select("id", "n", "x", "at", "open", "l"), "prefix")
    x, y = prefix.where("open").alias("p"), prefix.alias("q")
    need = f"cast(ceil({percent} * (p.n + q.n) / {100 + percent}) as long)"
    pairs = x.join(
        y,
        F.expr(f"p.x = q.x and p.l <> q.l and (not q.open or p.id < q.id) and p.at <= p.n - {need} + 1 and q.at <= q.n - {need} + 1"),
    )
    return pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
