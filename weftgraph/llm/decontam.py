"""Benchmark decontamination by spaced seeds.

A seed is a mask over neighbouring words; the hash takes the masked words and ignores the rest, so a substituted word
spoils only the seeds that look at it. The seeds of the benchmark and of the texts are two tables joined by hash; a bitmap
of the benchmark's hashes, of bounded size, keeps texts from sending seeds that no item has. Each hit fixes an alignment of
a text and an item, which is then verified word by word (by their 64-bit hashes), substitutions allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import blocks_of, bound_batches, hot_keys, remove_path, salted_join, written
from weftgraph.llm.shingles import BLOCK_BYTES, mixed, word_hashes

#: 1 = the word counts. Weight 6 each, spans 9 to 11, chosen to overlap little under shifts.
MASKS = ("111010011", "1100101011", "10110010101", "111111")
#: A contaminated text shares an aligned stretch of at least this many words with an item, or holds the whole item ...
MIN_WORDS = 13
#: ... and at least this share of them are equal.
MIN_SHARE = 0.8
#: Items of fewer words are not searched unless a caller asks for it: a word or two stand in many clean texts.
LEAST_WORDS = 3
#: The bitmap has about so many bits for each seed of the benchmark, within these powers of two (at most 16 MB).
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 256, 16, 27

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[128:] = False
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _SEPARATORS[ord(_a) : ord(_b) + 1] = False
_PLACE = np.random.default_rng(20_240_903).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of letters and digits (non-ASCII characters count as letters), in lower case."""
    h, n, _, _ = word_hashes([t.lower().encode("utf-8") for t in texts], _SEPARATORS)
    return h, n


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each word where the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = np.full(n, np.uint64(len(mask)), np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            s += h[k : k + n] * _PLACE[k]
    return mixed(s)


def best_stretch(equal: np.ndarray, share: float = MIN_SHARE) -> tuple[int, int, int]:
    """(start, length, equal words) of the longest stretch that begins and ends with an equal word and has at least that share of them."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    # equal - share * length >= 0 between two equal words: on prefix values, the farthest end for each beginning
    rank = np.arange(len(at))
    value = rank - share * at  # of a beginning at[i]; an end at[j] needs (j + 1) - share * (at[j] + 1) >= i - share * at[i]
    ends = rank + 1 - share * (at + 1)
    ahead = np.maximum.accumulate(ends[::-1])[::-1]  # falls with j: the last j whose ahead suffices is the farthest end
    best = (0, 0, 0)
    for i in range(len(at)):
        j = int(np.searchsorted(-ahead, -(value[i] - 1e-9), side="right")) - 1
        if j >= i and at[j] - at[i] + 1 > best[1]:
            best = (int(at[i]), int(at[j] - at[i] + 1), j - i + 1)
    return best


def _short_masks(n: int) -> list[tuple[int, str]]:
    """(place, mask) of a short item's seeds: runs, of which one is whole if no more than a fifth of the words are substituted."""
    parts = n // 5 + 1
    cuts = [k * n // parts for k in range(parts + 1)]
    return [(a, "1" * (b - a)) for a, b in zip(cuts, cuts[1:])]


def _item_seeds(w: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(mask, places, hashes) of an item. Items of MIN_WORDS and more may be met in part, so they have all seeds of all masks."""
    if len(w) < MIN_WORDS:
        for at, mask in _short_masks(len(w)):
            yield mask, np.array([at]), _seeds(w[at : at + len(mask)], mask)
    else:
        for mask in MASKS:
            s = _seeds(w, mask)
            yield mask, np.arange(len(s)), s


def _items(benchmark: DataFrame, id_col: str, text_col: str, least_words: int) -> tuple[DataFrame, str]:
    """k, item, words (hashes, eight bytes each), n: the items that are searched, as a table; and its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            h, n = _words(texts)
            ends = np.cumsum(n)
            long = n >= max(1, least_words)
            words = [h[e - m : e].tobytes() for e, m, ok in zip(ends, n, long) if ok]
            kept = b.column(0).filter(pa.array(long))
            yield pa.RecordBatch.from_arrays([kept, pa.array(words, pa.binary()), pa.array(n[long], pa.int64())], ["k", "words", "n"])

    numbered = benchmark.select(F.monotonically_increasing_id().alias("k"), F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("t"))
    numbered, path = written(numbered.where("t is not null"), "decontam-items")
    words = numbered.select("k", "t").mapInArrow(run, "k long, words binary, n long")
    items = written(numbered.select("k", "item").join(words, "k"), "decontam-words")
    remove_path(benchmark.sparkSession, path)
    return items


def _benchmark_seeds(items: DataFrame) -> DataFrame:
    """hash, mask, k, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for mask, at, s in _item_seeds(np.frombuffer(w, np.uint64)):
                    n = len(s)
                    columns = [pa.array(s.view(np.int64)), pa.array([mask] * n, pa.string()), pa.array([k] * n, pa.int64()), pa.array(at, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["hash", "mask", "k", "place"])

    return items.select("k", "words").mapInArrow(run, "hash long, mask string, k long, place long")


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, of which a hash sets its two. Words of 64 are summed up by or, so the driver gets at most 2**bits / 64 rows."""
    shifted = f"shiftrightunsigned(hash, {64 - bits})"
    mixed_ = f"((hash ^ shiftrightunsigned(hash, 17)) & {(1 << bits) - 1}L)"
    at = seeds.select(F.explode(F.expr(f"array({shifted}, {mixed_})")).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    table = np.zeros(1 << max(0, bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return table.view(np.uint64)


def _met(table: np.ndarray, bits: int, s: np.ndarray) -> np.ndarray:
    """Places in s of the hashes whose two bits are set."""
    is_set = lambda at: ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    found = np.flatnonzero(is_set((s >> np.uint64(64 - bits)).astype(np.int64)))
    left = s[found]
    return found[is_set(((left ^ (left >> np.uint64(17))) & np.uint64((1 << bits) - 1)).astype(np.int64))]


def _text_hits(rows: DataFrame, masks: list[str], table, bits: int) -> DataFrame:
    """id, words, hashes, places: the texts with seeds that the bitmap lets through."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [t or "" for t in whole.column(1).to_pylist()]
            for a, b in blocks_of([len(t) for t in texts], BLOCK_BYTES):
                h, n = _words(texts[a:b])
                ends = np.cumsum(n)
                found: dict[int, tuple[list, list]] = {}
                for mask in masks:
                    s = _seeds(h, mask)
                    at = _met(table.value, bits, s)
                    doc = np.searchsorted(ends, at, side="right")
                    inside = at + len(mask) <= ends[np.minimum(doc, len(ends) - 1)]
                    at, doc = at[inside], doc[inside]
                    edges = np.flatnonzero(np.diff(doc, prepend=-1))
                    for lo, hi in zip(edges, [*edges[1:], len(doc)]):
                        d = int(doc[lo])
                        hashes, places = found.setdefault(d, ([], []))
                        hashes.append(s[at[lo:hi]].view(np.int64))
                        places.append(at[lo:hi] - (ends[d] - n[d]))
                if found:
                    order = sorted(found)
                    columns = [
                        whole.column(0).take(pa.array([a + d for d in order])),
                        pa.array([h[ends[d] - n[d] : ends[d]].tobytes() for d in order], pa.binary()),
                        pa.array([np.concatenate(found[d][0]) for d in order], pa.list_(pa.int64())),
                        pa.array([np.concatenate(found[d][1]) for d in order], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "words", "hashes", "places"])

    return rows.mapInArrow(run, f"id {id_type}, words binary, hashes array<long>, places array<long>")


def judged(own: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the text, words, equal words) if a text's words contaminate where the item would begin at shift; else None."""
    low, high = max(0, shift), min(len(own), shift + len(item))
    equal = own[low:high] == item[low - shift : high - shift]
    start, length, same = best_stretch(equal)
    if length >= MIN_WORDS:
        return low + start, length, same
    if high - low == len(item) and int(equal.sum()) >= MIN_SHARE * len(item) - 1e-9:
        return low, len(item), int(equal.sum())
    return None


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates (uid, k, from, own, words, shift; own are the text's words from the place `from` on) that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, said = [], []
            for begin, own, item, shift in zip(*(b.column(c).to_pylist() for c in ("begin", "own", "words", "shift"))):
                hit = judged(np.frombuffer(own, np.uint64), np.frombuffer(item, np.uint64), shift - begin)
                keep.append(hit is not None)
                if hit:
                    said.append((hit[0] + begin, *hit[1:]))
            left = b.select(["uid", "k"]).filter(pa.array(keep, pa.bool_()))
            numbers = [pa.array([x[i] for x in said], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*left.columns, *numbers], ["uid", "k", "start_word", "n_words", "n_equal"])

    return candidates.mapInArrow(run, "uid long, k long, start_word long, n_words long, n_equal long")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """A row for each contaminated text and item: ids, start_word, n_words, n_equal, similarity (n_equal / n_words).

    A text is contaminated by an item if an aligned stretch of MIN_WORDS words, that begins and ends with an equal word, or
    the whole item is in it with a share of MIN_SHARE equal words. Whole items of up to 12 words are never missed; of
    stretches of 13 to 20 words with a fifth substituted, 98.6 % and more of all ways to substitute leave a seed. Null and
    empty texts have no rows; items that are null or have under least_words words are not searched. Repeated rows are
    reported each; of an item's stretches the longest, of ties the first. Very long texts are searched whole. Empty tables
    give no rows. Other columns are left out, so their names may be any. The result is a table in the shared folder.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    paths: list[str] = []

    def kept(frame: DataFrame, name: str) -> DataFrame:
        table, path = written(frame, f"decontam-{name}")
        paths.append(path)
        return table

    items, path = _items(benchmark, item_id, item_text, least_words)
    paths.append(path)
    seeds = kept(_benchmark_seeds(items), "seeds")
    masks = sorted(r[0] for r in seeds.select("mask").distinct().collect())  # MASKS and at most twelve runs
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_SEED * seeds.count()).bit_length()))
    table = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _text_hits(rows, masks, table, bits).withColumn("uid", F.monotonically_increasing_id())
    found = kept(found, "texts")
    hits = kept(found.select("uid", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("uid", "h.hashes", "h.places").toDF("uid", "hash", "at"), "hits")
    hot = hot_keys(hits.groupBy("hash").count(), hits.count())
    spots = salted_join(hits, seeds.select("hash", "k", "place"), "hash", "uid", hot)
    spots = kept(spots.select("uid", "k", (F.col("at") - F.col("place")).alias("shift")).distinct(), "spots")
    near = spots.join(found.select("uid", "words"), "uid").join(items.select("k", "n"), "k")
    begin = F.greatest(F.lit(0), F.col("shift"))
    own = F.substring("words", (begin * 8 + 1).cast("int"), ((F.col("n") + F.least(F.lit(0), F.col("shift"))) * 8).cast("int"))
    near = kept(near.select("uid", "k", "shift", begin.alias("begin"), own.alias("own")), "near")
    often = hot_keys(near.groupBy("k").count(), near.count())
    held = _verified(salted_join(near, items.select("k", "words"), "k", "uid", often))
    best = held.groupBy("uid", "k").agg(F.max(F.struct("n_words", (-F.col("start_word")).alias("minus"), "n_equal")).alias("x"))
    best = best.join(found.select("uid", "id"), "uid").join(items.select("k", "item"), "k")
    out = best.select(
        F.col("id").alias("id"), F.col("item"), (-F.col("x.minus")).alias("start_word"), F.col("x.n_words").alias("n_words"),
        F.col("x.n_equal").alias("n_equal"), (F.col("x.n_equal") / F.col("x.n_words")).alias("similarity"),
    )
    result, _ = written(out, "decontam-result")
    for path in paths:
        remove_path(spark, path)
    table.unpersist()
    return result.withColumnsRenamed({"id": id_col, "item": item_id})


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """The rows of docs whose text no item contaminates, with all their columns, whatever these are named. Null texts stay."""
    digest = F.md5(F.col(text_col).cast("string"))
    texts = docs.select(digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    found = contamination(texts, benchmark, "digest", "text", item_id, item_text, least_words)
    gone, _ = written(found.select("digest").distinct(), "decontam-gone")
    return docs.join(gone.select(F.col("digest").alias("__weft_digest")), digest == F.col("__weft_digest"), "left_anti")
