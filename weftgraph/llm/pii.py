"""Personal data: expressions propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import bound_batches, map_texts

#: Kinds in the order that breaks ties between spans that begin together; base kinds first.
#: A card_part or phone_part is a valid number inside a longer run of digits that is none itself; a phone_local has no
#: country code, so that only words nearby tell it from other numbers of that shape.
KINDS = ("email", "ip", "card", "phone", "iban", "card_part", "phone_part", "phone_local")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can begin at the first digit of a run only, and takes whole runs: possessive forms keep long texts linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Characters of an IBAN by country.
_IBAN_LENGTHS = {
    country: n
    for n, countries in (
        (15, "NO"), (16, "BE"), (18, "DK FI FO GL NL"), (19, "MK SI"), (20, "AT BA EE KZ LT LU XK"), (21, "CH HR LI LV"),
        (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ TL"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "PT ST"),
        (26, "IS TR"), (27, "FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HU LB PL SV"), (29, "BR PS QA UA"), (30, "JO KW MU"),
        (31, "MT SC"), (32, "LC"),
    )
    for country in countries.split()
}

_GROUP = re.compile(r"[0-9]+")
_PHONE_PART = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")

_PHONE_LOCAL = re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")

#: Prior score of a proposed span whose validator agrees, and the words whose nearness raises it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.7, "card_part": 0.6, "phone_part": 0.5, "phone_local": 0.4}
CONTEXT = {
    "email": ("email", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
CONTEXT |= {f"{k}_part": CONTEXT[k] for k in ("card", "phone")} | {"phone_local": CONTEXT["phone"]}
CONTEXT_BONUS = 0.2
#: Spans of added kinds need this score; base kinds are never dropped. So a phone_local needs a context word.
MIN_SCORE = 0.5
CONTEXT_CHARS = 40
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10: the first four characters moved to the end, letters as 10 to 35."""
    rest = 0
    for ch in iban[4:] + iban[:4]:
        v = int(ch, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str):
    """An email has one @, so each @ is tried once with the run of local characters before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


#: Digit groups that a card number is written in at most.
_CARD_GROUPS = 5


def _card_parts(text: str, start: int, end: int):
    """Whole groups of digits, from left to right the longest that make a card number."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        for j in range(min(len(groups), i + _CARD_GROUPS), i, -1):
            said = text[groups[i][0] : groups[j - 1][1]]
            if len(said) <= 30 and 12 <= len(d := _digits(said)) <= 19 and luhn(d):
                yield groups[i][0], groups[j - 1][1]
                i = j
                break
        else:
            i += 1


def _ibans(text: str):
    """Of each run of groups the part from its beginning, in whole words, that is an IBAN: of several the one of its country's length, else the longest."""
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        usual, found = _IBAN_LENGTHS.get(text[start : start + 2]), 0
        while end > start:
            bare = text[start:end].replace(" ", "")
            if 15 <= len(bare) <= 34 and (not found or len(bare) == usual) and mod97(bare):
                found = end
            end = text.rfind(" ", start, end)  # below start if there is no shorter part
        if found:
            yield start, found
        m = _IBAN.search(text, found or start + 1)


def propose(text: str):
    """(kind, start, end) of what the expressions find and the validators confirm."""
    for s, e in _emails(text):
        yield "email", s, e
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_octet, m.group().split("."))):
                yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield "card", *m.span()
        else:
            for span in _card_parts(text, *m.span()):
                yield "card_part", *span
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", *m.span()
            elif (part := _PHONE_PART.match(text, m.start(), m.end())) and 9 <= len(_digits(part.group())) <= 15:
                yield "phone_part", *part.span()
    for span in _ibans(text):
        yield "iban", *span
    for m in _PHONE_LOCAL.finditer(text):
        yield "phone_local", *m.span()


def find_spans(text: str, min_score: float = MIN_SCORE) -> list[Span]:
    """All spans by start, then kind. Those of added kinds have at least min_score and, a phone_local, no other span's digits."""
    out: list[Span] = []
    taken: list[tuple[int, int]] | None = None
    for kind, s, e in propose(text):
        if kind == "phone_local":  # these come last
            taken = sorted((x.start, x.end) for x in out if x.kind != kind) if taken is None else taken
            k = bisect_left(taken, (e,))
            if any(end > s for _, end in taken[max(0, k - len(KINDS)) : k]):
                continue
        near = text[max(0, s - CONTEXT_CHARS) : s] + " " + text[e : e + CONTEXT_CHARS]
        words = {w.lower() for w in _WORD.findall(near)}
        score = min(1.0, PRIOR[kind] + (CONTEXT_BONUS if words.intersection(CONTEXT[kind]) else 0.0))
        if kind in BASE or score >= min_score:
            out.append(Span(kind, s, e, score))
    return sorted(out, key=lambda x: (x.start, KINDS.index(x.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """Spans become <KIND>; where spans overlap, their union becomes one mark with the first span's kind."""
    parts, pos, i = [], 0, 0
    while i < len(spans):
        s, e, kind = spans[i].start, spans[i].end, spans[i].kind
        while (i := i + 1) < len(spans) and spans[i].start < e:
            e = max(e, spans[i].end)
        parts += [text[pos:s], f"<{kind.upper()}>"]
        pos = e
    return "".join(parts) + text[pos:]


SPAN_SCHEMA = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, spans (kind, start, end in code points, end exclusive, score), redacted text.

    A null text counts as empty and is redacted to null; an empty text has no spans. Spans that begin together stand in
    the order of KINDS; repeated rows are judged each. A very long text is searched whole, in time in proportion to its
    length. Other columns are left out, so their names may be any. An empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("spans", T._parse_datatype_string(SPAN_SCHEMA)),
            T.StructField("redacted", T.StringType()),
        ]
    )
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, texts = [], []
        for t in batch.column("text"):
            t = t.as_py()
            found = find_spans(t) if t else []
            spans.append([x.__dict__ for x in found])
            texts.append(redact(t, found) if found else t)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(spans, span_type), pa.array(texts, pa.string())], ["id", "spans", "redacted"]
        )

    out = map_texts(df, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, schema, run)
    return out.withColumnRenamed("id", id_col)


def redact_rows(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with personal data in its texts replaced by marks; every row and column stays, whatever its name, null texts too.

    Empty texts and empty tables stay as they are; repeated rows are judged each, very long texts whole.

    length_col, if given, becomes the length of the new text in code points where the text has changed.
    """
    bound_batches(df.sparkSession)
    at = df.columns.index(text_col)
    long_at = df.columns.index(length_col) if length_col else None

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            lengths = b.column(long_at).to_pylist() if long_at is not None else []
            for i, t in enumerate(texts):
                if t and (found := find_spans(t)):
                    texts[i] = redact(t, found)
                    if lengths:
                        lengths[i] = len(texts[i])
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if lengths:
                columns[long_at] = pa.array(lengths, b.schema.field(long_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return df.mapInArrow(run, df.schema)


def spans_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, the joined list of all spans and that of their scores."""
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 1)), ",").alias("scores")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return df.select(id_col, *[n(k) for k in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), scores)


__all__ = ["Span", "find_spans", "luhn", "mod97", "pii_spans", "redact", "spans_digest"]
