"""Improbable-feature digests: rare byte windows, chosen by entropy, in chained Bloom filters.

Every window of 8 bytes has an entropy, and a rank that says how improbable that entropy is for text. Within each
stretch of 8 consecutive windows the rarest gets a vote; of equally rare ones that with the least hash, so votes for
the same bytes come together wherever they stand. Windows with enough votes are features; their hashes set five bits
each in a filter of 2048 bits; a filter that holds 160 features is closed and the next one begun. Two digests are
compared filter by filter through their common bits beyond what chance gives. A text shorter than a window is one
window, and if no window has enough votes, those with the most are features: only an empty text has none.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import blocks_of, bound_batches, ragged_index

WINDOW = 8
STRETCH = 8
VOTES = 2
FILTER_BITS = 2048
HASHES = 5
PER_FILTER = 160
#: Part of the way from chance to full agreement that common bits must exceed to count.
CUTOFF = 0.3
#: Entropies of text windows lie round this mean with this spread (bits per byte); rarity is the distance from it.
TYPICAL, SPREAD = 2.7, 0.3
BLOCK_BYTES = 400_000
#: Pairs of filters compared at once.
PAIRS = 200_000
#: Texts dealt by ascending id go into ranges of about so many bytes, but not more than so many ranges.
RANGE_BYTES, MOST_RANGES = 64_000_000, 4096

_rng = np.random.default_rng(20_240_910)
_POSITION = _rng.integers(0, 1 << 64, WINDOW, np.uint64) | np.uint64(1)
_SYMBOL = _rng.integers(0, 1 << 64, 256, np.uint64)


@lru_cache(1)
def _gain() -> np.ndarray:
    """gain[c]: change of the sum of n log2 n over a window's byte counts when one count grows from c - 1 to c (scaled integers)."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    f = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0)
    return np.round(np.diff(f, prepend=0.0) * (1 << 16)).astype(np.int64)


def window_entropies(data: np.ndarray) -> np.ndarray:
    """Bits per byte of every window, in units of 1/2**16: integers, so that equal windows have equal entropies wherever they stand."""
    n = len(data) - WINDOW + 1
    ahead = np.ones(len(data), np.uint8)  # times the byte occurs in the window it begins
    behind = np.ones(len(data), np.uint8)  # and in the window it ends
    same = np.empty(len(data), bool)
    for k in range(1, WINDOW):
        e = np.equal(data[k:], data[:-k], out=same[: len(data) - k])
        ahead[:-k] += e
        behind[k:] += e
    gain = _gain()
    first = int(gain.cumsum()[np.bincount(data[:WINDOW], minlength=256)].sum())
    total = np.empty(n, np.int64)
    total[0] = first
    if n > 1:
        np.cumsum(gain[behind[WINDOW:]] - gain[ahead[: n - 1]], out=total[1:])
        total[1:] += first
    return round(math.log2(WINDOW) * (1 << 16)) - total // WINDOW


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of that width."""
    n = len(data) - width + 1
    symbol = _SYMBOL[data]
    h = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        h += symbol[k : k + n] * _POSITION[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_keys(data: np.ndarray) -> np.ndarray:
    """For each window its rank, the least first: how typical its entropy is (10 bits), then 53 bits of its hash."""
    off = np.abs(window_entropies(data) - int(TYPICAL * (1 << 16)))
    off = np.minimum(off * 1000 // int(6 * SPREAD * (1 << 16)), 1000)  # rarity: 0 typical, 1000 least probable
    return ((1000 - off) << 53) | (_hashes(data, WINDOW) >> np.uint64(11)).astype(np.int64)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the distinct hashes of its features in order of place.

    Texts are taken in blocks of BLOCK_BYTES, a longer one in pieces that overlap by a stretch, so memory does not grow
    with a text's length.
    """
    reach = WINDOW + STRETCH - 2
    pieces = [(i, a, t[a : a + BLOCK_BYTES + reach]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - reach), BLOCK_BYTES)]
    voted: dict[int, list] = {}
    for a, b in blocks_of([len(p[2]) for p in pieces], BLOCK_BYTES + reach):
        for (i, _, _), runs in zip(pieces[a:b], _votes([p[2] for p in pieces[a:b]])):
            voted.setdefault(i, []).append(runs)
    return [_chosen(voted[i]) for i in range(len(texts))]


def _votes(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (keys, votes) of the windows that won neighbouring stretches, in order of place."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in texts]
    for i, t in enumerate(texts):
        if 0 < len(t) < WINDOW:
            out[i] = _hashes(np.frombuffer(t, np.uint8), len(t)).view(np.int64), np.ones(1, np.int64)
    long = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    if not long:
        return out
    data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    size = np.array([len(texts[i]) for i in long], np.int64)
    begin = np.cumsum(size) - size
    windows = size - WINDOW + 1
    key = np.full(len(data), np.iinfo(np.int64).max)
    key[: len(data) - WINDOW + 1] = window_keys(data)
    across = ragged_index(begin + windows, np.minimum(WINDOW - 1, size))  # windows that reach into the next text
    key[across] = np.iinfo(np.int64).max
    least, width = key, 1
    while width < STRETCH:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    stretches = np.maximum(1, windows - STRETCH + 1)
    won = least[ragged_index(begin, stretches)]
    stops = np.cumsum(stretches)
    turn = np.ones(len(won), bool)
    np.not_equal(won[1:], won[:-1], out=turn[1:])
    turn[stops[:-1]] = True
    at = np.flatnonzero(turn)
    votes = np.diff(np.append(at, len(won)))
    cuts = np.searchsorted(at, stops)
    for j, i in enumerate(long):
        lo, hi = (cuts[j - 1] if j else 0), cuts[j]
        out[i] = won[at[lo:hi]], votes[lo:hi]
    return out


def _chosen(runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    keys, votes = (np.concatenate(x) for x in zip(*runs))
    if not len(keys):
        return np.empty(0, np.uint64)
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.bincount(which, votes)
    found = sums >= min(VOTES, sums.max())
    return distinct[found][np.argsort(first[found])].view(np.uint64)


def filters(feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filters x 256 bytes, features in each)."""
    n = -(-len(feats) // PER_FILTER)
    bits = np.zeros((n, FILTER_BITS), np.uint8)
    which = np.arange(len(feats)) // PER_FILTER
    for k in range(HASHES):
        bits[which, ((feats >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), np.bincount(which, minlength=n)


def fingerprint(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """count:filter pairs, the filters in base64, joined by commas; empty for an empty text."""
    return ",".join(f"{c}:{base64.b64encode(f.tobytes()).decode()}" for f, c in zip(*sketch))


def parse(said: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [p.split(":") for p in said.split(",") if p]
    rows = [np.frombuffer(base64.b64decode(f), np.uint8) for _, f in parts]
    return np.array(rows, np.uint8).reshape(len(parts), FILTER_BITS // 8), np.array([int(c) for c, _ in parts], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: for each filter of the digest with fewer, its best normalised overlap with one of the other's, weighted by features.

    The overlap of two filters is their common bits beyond the cutoff, over those possible beyond it. Equal digests
    give 1, an empty one and another give 0. Digests of n and m filters take n * m comparisons, PAIRS at once.
    """
    if len(a[1]) == len(b[1]) and np.array_equal(a[0], b[0]):
        return 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0
    if (len(a[1]), int(a[1].sum())) > (len(b[1]), int(b[1].sum())):
        a, b = b, a
    left, right = (np.ascontiguousarray(f[0]).view(np.uint64) for f in (a, b))
    x, y = (np.bitwise_count(f).sum(axis=1).astype(np.float64) for f in (left, right))
    best = []
    step = max(1, PAIRS // len(right))
    for k in range(0, len(left), step):
        common = np.bitwise_count(left[k : k + step, None, :] & right[None, :, :]).sum(axis=2).astype(np.float64)
        most = np.minimum(x[k : k + step, None], y[None, :])
        chance = x[k : k + step, None] * y[None, :] / FILTER_BITS
        floor = CUTOFF * (most - chance) + chance
        best.append(np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0.0, 1.0).max(axis=1))
    return float(np.average(np.concatenate(best), weights=a[1]))


def _bounds_up_to(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most value, in two steps of about the square root of their number each."""
    step = max(1, math.isqrt(len(bounds)))
    listed = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    count = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    whole = count(listed(bounds[step - 1 :: step])) * step
    return F.when(value.isNotNull(), whole + count(F.slice(listed(bounds), whole + 1, F.lit(step))))


def with_next(df: DataFrame, id_col: str, text_col: str, fn, schema: T.StructType) -> DataFrame:
    """Run fn(ids, texts, next_texts) over rows in ascending id order, next_texts being the following row's; the last is followed by the first.

    Rows are dealt into ranges of ids (one shuffle of the texts). The first row of each range also travels to the
    range before it; which rows these are is found on ids alone and is one row for each range.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))
    bounds = docs.where("id is not null").stat.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(x) for x in bounds})
    part = F.lit(0)
    if bounds:
        part = F.coalesce(_bounds_up_to(F.col("id"), bounds), F.lit(0))  # a null id stands first
    docs = docs.withColumn("part", part)
    order = F.struct(F.col("id").isNotNull().alias("some"), "id", F.xxhash64("text").alias("tie"))
    firsts = sorted((r["part"], tuple(r["first"])) for r in docs.groupBy("part").agg(F.min(order).alias("first")).collect())
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    copies = docs.limit(0)
    if firsts:
        said = spark.createDataFrame([(p, *f, before[p]) for p, f in firsts], "part int, some boolean, fid long, tie long, goes int")
        hit = (docs["part"] == said["part"]) & docs["id"].eqNullSafe(said["fid"]) & (F.xxhash64(docs["text"]) == said["tie"])
        copies = docs.join(F.broadcast(said), hit).select("id", "text", said["goes"].alias("part"))  # a row for each range
        copies = copies.dropDuplicates(["id", "part"])
    everything = docs.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    everything = everything.withColumn("tie", F.xxhash64("text"))
    dealt = everything.repartition(n, "part").sortWithinPartitions("part", "copy", "id", "tie").select("id", "text", "part", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple], follows: list[str]) -> pa.RecordBatch:
            return fn([r[0] for r in rows], [r[1] for r in rows], follows)

        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                ids, texts, parts, copy = (b.column(k).to_pylist() for k in range(4))
                rows, follows = [], []
                for i, t, c in zip(ids, texts, copy):
                    if held:
                        rows.append(held.pop())
                        follows.append(t)
                    if not c:
                        held.append((i, t))
                if rows:
                    yield flush(rows, follows)

    return dealt.mapInArrow(run, schema)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty; an empty text has an empty fingerprint, alike to an empty one only. Equal texts have equal
    fingerprints. Very long texts are worked off in pieces; comparing two of n filters takes n * n steps, 900 bytes or so
    to a filter. Rows with equal ids are ordered by a hash of their text; null ids come first. A single row is followed by
    itself. An empty table gives no rows. ids are long; other columns are left out, so their names may be any.
    """
    schema = T._parse_datatype_string(
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

    def run(ids: list, texts: list[str], follows: list[str]) -> pa.RecordBatch:
        edited = [edited_text(t, f) for t, f in zip(texts, follows)]
        # a row's following text is the next row's own, but for the last and where a range ends
        chain = [k for k in range(len(texts)) if k + 1 == len(texts) or follows[k] is not texts[k + 1]]
        raw, new = ([t.encode("utf-8") for t in x] for x in (texts, edited))
        made = [filters(f) for f in features(raw + new + [follows[k].encode("utf-8") for k in chain])]
        own, changed, extra = made[: len(raw)], made[len(raw) : 2 * len(raw)], dict(zip(chain, made[2 * len(raw) :]))
        after = [extra[k] if k in extra else own[k + 1] for k in range(len(raw))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
                pa.array([fingerprint(x) for x in own]),
                pa.array([fingerprint(x) for x in changed]),
                pa.array([likeness(*x) for x in zip(own, changed)], pa.float64()),
                pa.array([likeness(*x) for x in zip(own, after)], pa.float64()),
            ],
            schema.names,
        )

    return with_next(df, id_col, text_col, run, schema).withColumnRenamed("id", id_col)
