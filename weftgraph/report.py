"""Violations as one DataFrame, their sentences, results, and assertions for tests."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "kind string, subject string, mood string, requirement string, object string, finding string, metric string, value double, "
    "comparison string, limit double, abstractness double, instability double, members array<string>, "
    "dependencies array<struct<source:string,target:string>>"
)
COLUMNS = dict(part.strip().split(" ", 1) for part in SCHEMA.replace("source:string,target:string", "source:string;target:string").split(","))
COLUMNS = {k: v.replace(";", ",") for k, v in COLUMNS.items()}

EMPTY_TEST, FILE_CYCLE, FILE_NAMING = "empty-test", "file-cycle", "file-naming"
FILE_DEPENDENCY, FILE_EXTERNAL, FILE_ADHERENCE = "file-dependency", "file-external-dependency", "file-adherence"
LAYER_DEPENDENCY, ZONE, THRESHOLD, SATISFACTION = "layer-dependency", "metrics-zone", "metrics-threshold", "metrics-satisfaction"
SLICE_DEPENDENCY, SLICE_DIAGRAM = "slice-dependency", "slice-diagram"


def _said(kind: str, columns: dict) -> dict[str, Column]:
    said = {"kind": F.lit(kind)} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    return {c: said.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()}


def violations(df: DataFrame, kind: str, **columns: Column | str | float) -> DataFrame:
    """df's rows as violations of one kind; what is not given is null."""
    return df.select(*_said(kind, columns).values())


def tallies(df: DataFrame, kind: str, n: Column, **columns: Column | str | float) -> DataFrame:
    """The same with the number of dependencies, n, in place of their list."""
    said = _said(kind, columns)
    del said["dependencies"]
    return df.select(*said.values(), n.cast("long").alias("n"))


def tallied(found: DataFrame) -> DataFrame:
    """Violations as tallies."""
    n = F.when(F.col("dependencies").isNotNull(), F.size("dependencies")).cast("long")
    return found.withColumn("n", n).drop("dependencies")


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def empty_tests(spark: SparkSession, populations: list[tuple[str, str]]) -> DataFrame:
    """A violation for each (subject, selectors) that nothing matched."""
    rows = [(EMPTY_TEST, s, None, sel, *([None] * (len(COLUMNS) - 4))) for s, sel in populations]
    return spark.createDataFrame(rows, SCHEMA)


def figure(x: float | None) -> str:
    """The shortest text that reads back as x, without a needless fraction; exponents from 1e21 and below 1e-4."""
    if x is None:
        return ""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    digits = repr(abs(x))
    mantissa, _, exp = digits.partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    point = len(whole) + int(exp or 0)
    bare = (whole + frac).lstrip("0")
    point -= len(whole + frac) - len((whole + frac).lstrip("0"))
    bare = bare.rstrip("0")
    sign = "-" if math.copysign(1, x) < 0 else ""
    if not bare:
        return sign + "0"
    if point - 1 < -4 or point - 1 >= 21:
        tail = "." + bare[1:] if bare[1:] else ""
        return f"{sign}{bare[0]}{tail}e{'-' if point < 1 else '+'}{abs(point - 1):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{bare}"
    return sign + (bare.ljust(point, "0") if len(bare) <= point else f"{bare[:point]}.{bare[point:]}")


@dataclass(frozen=True)
class Palette:
    """ANSI codes for parts of a message; all empty unless asked for."""

    subject: str = ""
    requirement: str = ""
    finding: str = ""
    hint: str = ""
    passed: str = ""
    failure: str = ""

    def paint(self, part: str, text: str) -> str:
        code = getattr(self, part)
        return f"\x1b[{code}m{text}\x1b[0m" if code and text else text


COLOURS = Palette(subject="1", requirement="36", finding="31", hint="2", passed="32", failure="31")

# Phrases of messages.
EMPTY_HINT = "an empty rule would hold forever, so selecting nothing is a violation rather than a pass (AllowEmptyTests opts out)"
DIAGRAM_REQUIREMENT = "should, adhere to diagram"
CYCLE_REQUIREMENT = "should, have no cycles"
UNDRAWN, UNDECLARED, ABSENT = "undrawn dependency", "undeclared slice", "absent component"


@dataclass(frozen=True)
class MessageOptions:
    max_violations: int = 0
    palette: Palette = field(default_factory=Palette)


def _through(v: Row) -> str:
    return " through " + ", ".join(f"{d['source']} -> {d['target']}" for d in v["dependencies"]) if v["dependencies"] else ""


def _list(v: Row) -> str:
    return "it depends on " + ", ".join(v["members"]) if v["members"] else "it depends on none of them"


def _say(v: Row) -> tuple[str, str, str]:
    """subject, requirement, finding."""
    mood, kind = v["mood"], v["kind"]
    negated = mood == "should not"
    does, stands = ("it does", "it is") if negated else ("it does not", "it is not")
    match kind:
        case "file-cycle":
            if not v["members"]:
                return "a cycle through no files", CYCLE_REQUIREMENT, ""
            return v["members"][0], CYCLE_REQUIREMENT, "it depends on itself through " + " -> ".join([*v["members"], v["members"][0]])
        case "file-naming":
            return v["subject"], f"{mood}, {v['requirement']}", does
        case "file-adherence":
            return v["subject"], f'{mood}, adhere to "{v["requirement"]}"', does
        case "file-dependency":
            return v["subject"], f"{mood}, depend on files" + (f", {v['requirement']}" if v["requirement"] else ""), _list(v)
        case "file-external-dependency":
            return v["subject"], f"{mood}, depend on external modules" + (f", {v['requirement']}" if v["requirement"] else ""), _list(v)
        case "layer-dependency":
            verb = "may not depend on" if negated else "may only depend on"
            named = " layers " + ", ".join(f'"{x}"' for x in v["members"]) if v["members"] else " no layers"
            return f'layer "{v["subject"]}"', verb + named, f"it depends on {v['object']}{_through(v)}"
        case "metrics-zone":
            at = f", at abstractness {figure(v['abstractness'])} and instability {figure(v['instability'])}"
            return f'component "{v["subject"]}"', f"{mood}, be in {v['requirement']}", stands + at
        case "metrics-threshold":
            than = f"{v['comparison']} " if v["comparison"] else ""
            return v["subject"], f"{mood}, be {than}{figure(v['limit'])}", f"{stands}, at {v['metric']} {figure(v['value'])}"
        case "metrics-satisfaction":
            return v["subject"], f'{mood}, satisfy "{v["requirement"]}"', f"{does}, at {v['metric']} {figure(v['value'])}"
        case "slice-dependency":
            found = f"it depends on {v['object']}{_through(v)}" if v["dependencies"] else f"it does not depend on {v['object']}"
            return f'slice "{v["subject"]}"', f'{mood}, contain dependency "{v["object"]}"', found
        case "slice-diagram":
            said = {
                UNDRAWN: f"it depends on {v['object']}, which the diagram does not draw{_through(v)}",
                UNDECLARED: "the diagram does not declare it",
                ABSENT: "the project has no slice for it",
            }.get(v["finding"], v["finding"])
            return f'{"component" if v["finding"] == ABSENT else "slice"} "{v["subject"]}"', DIAGRAM_REQUIREMENT, said
    return kind or "unknown", v["subject"] or "no phrase is known for this kind", ""


def sentence(v: Row, palette: Palette = Palette()) -> str:
    if v["kind"] == EMPTY_TEST:
        out = palette.paint("subject", f"no {v['subject']} matched" if v["subject"] else "nothing matched")
        if v["requirement"]:
            out += ": " + palette.paint("requirement", v["requirement"])
        return out + "; " + palette.paint("hint", EMPTY_HINT)
    subject, requirement, finding = _say(v)
    out = palette.paint("subject", subject) + ": " + palette.paint("requirement", requirement)
    return out + ("; " + palette.paint("finding", finding) if finding else "")


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


@dataclass(frozen=True)
class Result:
    passed: bool
    message: str


def result(found: DataFrame, options: MessageOptions | None = None) -> Result:
    """Passed, or a numbered list; with max_violations only so many rows come to the driver, the total is counted."""
    options = options or MessageOptions()
    p = options.palette
    if options.max_violations > 0:
        rows = found.limit(options.max_violations + 1).collect()
        total = len(rows) if len(rows) <= options.max_violations else found.count()
        rows = rows[: options.max_violations]
    else:
        rows = found.collect()
        total = len(rows)
    if not total:
        return Result(True, p.paint("passed", "no violations"))
    lines = [p.paint("failure", plural(total, "violation") + ":")]
    lines += [f"  {i}. {sentence(v, p)}" for i, v in enumerate(rows, 1)]
    if total > len(rows):
        more = f"... and {plural(total - len(rows), 'violation')} not listed, because MaxViolations is {options.max_violations}"
        lines.append("  " + p.paint("hint", more))
    return Result(False, "\n".join(lines))


class Checkable(Protocol):
    """Any rule, also a user's own."""

    def check(self, options: Any = None) -> DataFrame: ...


def assert_passes(rule: Checkable | None, options: Any = None, messages: MessageOptions | None = None) -> None:
    if rule is None:
        raise AssertionError("there is no rule to check")
    got = result(rule.check(options), messages)
    if not got.passed:
        raise AssertionError(f"{rule}\n{got.message}")


def assert_all_pass(rules: Mapping[str, Checkable], options: Any = None, messages: MessageOptions | None = None) -> None:
    """Checks rules by name in order and reports every failure; no rules at all is a failure."""
    if not rules:
        raise AssertionError("there are no rules to check")
    failed = []
    for name in sorted(rules):
        try:
            assert_passes(rules[name], options, messages)
        except AssertionError as e:
            failed.append(f"{name}: {e}")
    if failed:
        raise AssertionError("\n\n".join(failed))
