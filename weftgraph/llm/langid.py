"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import blocks_of, bound_batches
from weftgraph.llm.pretokens import LETTER, class_table

# Families of common language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
    "austronesian": ("id", "ms", "tl"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMENSIONS = 1 << 14
#: Relative frequencies of n-grams are multiplied by this, which brings them near unit length.
SCALE = 20.0
#: A margin of one support vector as a log-odds.
SHARPNESS = 3.0
BLOCK_CHARS = 500_000
#: Bound on the labelled rows fitted on, per language.
PER_LANGUAGE = 300
#: And on the characters of their texts together, per language; rows beyond it are not fitted on.
LANGUAGE_CHARS = 4_000_000
UNKNOWN = "und"


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigram and trigram that begin at each place (the end is padded)."""
    a = c.astype(np.uint32)
    b = np.append(a[1:], np.uint32(32))
    d = np.append(a[2:], np.full(min(2, len(a)), 32, np.uint32))
    two = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    three = two * np.uint32(0xC2B2AE3D) + d * np.uint32(0x27D4EB2F)
    bits = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    return (two * np.uint32(0x165667B1)) >> bits, (three ^ three >> np.uint32(15)) * np.uint32(0x9E3779B1) >> bits


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case letters of the texts, anything else a space; two spaces end each text), ends of texts, letters in each."""
    joined = "".join(t.lower() + "  " for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = class_table()[c] == LETTER
    lens = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    ends = np.cumsum(lens)
    n = np.diff(np.concatenate([[0], np.cumsum(letter)])[ends], prepend=0)
    return np.where(letter, c, np.uint32(32)), ends, n


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, scaled relative frequencies) of a text's bigrams and trigrams that begin with a letter."""
    c, _, _ = _codes([text])
    two, three = _grams(c)
    real = c != 32
    n = np.bincount(np.concatenate([two[real], three[real]]), minlength=DIMENSIONS)
    at = np.flatnonzero(n)
    return at, n[at] * (SCALE / max(1, int(real.sum())))


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: list[int], c: float = 10.0, epochs: int = 30, seed: int = 1) -> np.ndarray:
    """Linear SVM by dual coordinate descent; the last weight is the bias."""
    w = np.zeros(DIMENSIONS + 1)
    alpha = np.zeros(len(rows))
    rows = [(np.append(i, DIMENSIONS), np.append(v, 1.0)) for i, v in rows]
    norm = [float(v @ v) for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            grad = signs[k] * float(w[i] @ v) - 1
            new = min(max(alpha[k] - grad / norm[k], 0.0), c)
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * signs[k] * v
                most = max(most, abs(new - alpha[k]) * norm[k])
                alpha[k] = new
        if most < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    """Pairs of families, then pairs of languages within a family; weights has a column for each pair."""

    languages: list[str]
    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each pair's first over its second, for each text; letters in each text)."""
        out, letters = [np.empty((0, len(self.pairs)))], [np.empty(0, np.int64)]
        for a, b in blocks_of([len(t) for t in texts], BLOCK_CHARS):
            c, ends, n = _codes(texts[a:b])
            total = np.empty((b - a, len(self.pairs)))
            real = np.flatnonzero(c != 32)
            two, three = (g[real] for g in _grams(c))
            stops = np.searchsorted(real, ends)
            starts = np.concatenate([[0], stops[:-1]])
            for k in range(len(self.pairs)):
                w = self.weights[:-1, k]
                run = np.concatenate([[0.0], np.cumsum(w[two] + w[three], dtype=np.float64)])
                total[:, k] = (run[stops] - run[starts]) * (SCALE / np.maximum(n, 1)) + self.weights[-1, k]
            out.append(total)
            letters.append(n)
        return np.concatenate(out), np.concatenate(letters)

    def _best(self, classes: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """Most pairwise wins, then the largest sum of margins; and the mean probability of its pairs."""
        if len(classes) == 1:
            return classes[0], 1.0
        wins, sums, chance = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0), dict.fromkeys(classes, 0.0)
        for a, b in combinations(classes, 2):
            m = margin[a, b]
            p = 1 / (1 + np.exp(-SHARPNESS * min(50.0, max(-50.0, m))))
            wins[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            chance[a] += p
            chance[b] += 1 - p
        best = max(classes, key=lambda x: (wins[x], sums[x]))
        return best, float(chance[best] / (len(classes) - 1))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        margins, letters = self.margins(texts)
        out = []
        for row, n in zip(margins, letters):
            if not n:
                out.append((UNKNOWN, 0.0))
                continue
            margin = dict(zip(self.pairs, row.tolist()))
            family, p = self._best(self.families, margin)
            language, q = self._best(self.members[family], margin)
            out.append((language, min(1.0, max(0.0, p * q))))
        return out


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """rows: (language, text). Texts without letters teach nothing."""
    made: dict[str, list] = {}
    for lang, text in rows:
        at, v = gram_counts(text)
        if len(at):
            made.setdefault(lang, []).append((at, v))
    languages = sorted(made)
    family = lambda x: f"family {FAMILY_OF.get(x, x)}"
    families = sorted({family(x) for x in languages})
    members = {f: [x for x in languages if family(x) == f] for f in families}
    of_family = {f: [r for x in members[f] for r in made[x]] for f in families}
    pairs = [*combinations(families, 2), *(p for f in families for p in combinations(members[f], 2))]
    both = of_family | made
    weights = np.zeros((DIMENSIONS + 1, len(pairs)), np.float32)
    for k, (a, b) in enumerate(pairs):
        weights[:, k] = train_svm(both[a] + both[b], [1] * len(both[a]) + [-1] * len(both[b]))
    return LanguageModel(languages, families, members, pairs, weights)


def labelled_sample(df: DataFrame, allowed, per_language: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most per_language rows of each language among the allowed ones with text and language, those with the least hash of their id.

    A row counts only while the texts up to it have at most LANGUAGE_CHARS characters together, so what comes to the
    driver is bounded whatever the texts' lengths.
    """
    able = df.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in able.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit(4), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_language / n + 20 / n))])
    some = able.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"), F.col(id_col).alias("id"))
    some = some.where(F.col("draw") <= share[F.col("lang")])
    order = W.partitionBy("lang").orderBy("draw", "id", F.xxhash64("text"))
    some = some.where(F.length("text") <= LANGUAGE_CHARS)
    picked = some.withColumns({"k": F.row_number().over(order), "sum": F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, 0))})
    picked = picked.where((F.col("k") <= per_language) & (F.col("sum") <= LANGUAGE_CHARS))
    return [(r["lang"], r["text"]) for r in picked.orderBy("lang", "k").select("lang", "text").collect()]


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _fitted(df: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str):
    """The model, sent to executors: 64 KB for each pair of families or of languages within one."""
    model = fit(labelled_sample(df, ~held_out(id_col), per_language, id_col, text_col, lang_col))
    return df.sparkSession.sparkContext.broadcast(model)


def keep_known(df: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose text has a predicted language, with all their columns, whatever these are named.

    Texts that are null, empty or without letters go. All go if no row says its language to learn from.
    """
    bound_batches(df.sparkSession)
    shared, at = _fitted(df, per_language, id_col, text_col, lang_col), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = shared.value.predict([t or "" for t in b.column(at).to_pylist()])
                yield b.filter(pa.array([x[0] != UNKNOWN for x in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def predict_languages(
    df: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """df plus held_out, lang_pred and score; columns of df with these names are replaced.

    Fitted on at most per_language rows a language that are not held out; every row is predicted from its whole text
    alone, however long. A text that is null or has no letter gets `und` and score 0, and so does everything if nothing is
    labelled. Of classes with as many wins the larger sum of margins decides, of equal sums the first by name. Repeated rows
    are judged each; an empty table gives no rows.
    """
    df = df.select(*[c for c in df.columns if c not in ("held_out", "lang_pred", "score")])
    shared = _fitted(df, per_language, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = names.index(text_col)
        for b in batches:
            if not b.num_rows:
                continue
            said = model.predict([t or "" for t in b.column(at).to_pylist()])
            columns = [*b.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, out_names)

    bound_batches(df.sparkSession)
    names = df.columns
    out_names = [*names, "lang_pred", "score"]
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(run, schema).withColumn("held_out", held_out(id_col))
