"""Globs, regular expressions and literals as boolean columns, and the filters rules are made of."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.errors import UserError
from weftgraph.functions import identifiers

GLOB, REGEX, LITERAL = "glob", "regex", "literal"

#: What of an identifier a filter looks at -> the column expression for it.
TARGETS: dict[str, Callable[[Column], Column]] = {
    "path": lambda c: c,
    "filename": identifiers.base,
    "path without filename": identifiers.folder,
    "classname": identifiers.classname,
}
_SPECIAL = set(r".^$*+?()[]{}|\\&#-~")


def normalize_separators(pattern: str) -> str:
    said = re.sub(r"[/\\]+", "/", pattern.strip())
    return said[:-1] if len(said) > 1 and said.endswith("/") else said


def _literal(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """The character class that begins at `[`, and where it ends; None if it is never closed."""
    i = at + 1
    negated = i < len(glob) and glob[i] in "!^"
    i += negated
    first = i
    while i < len(glob) and (glob[i] != "]" or i == first):
        i += 1
    if i >= len(glob):
        return None
    body = "".join(ch if ch == "-" or ch not in _SPECIAL else "\\" + ch for ch in glob[first:i])
    return f"[{'^' if negated else ''}{body}]", i + 1


def glob_to_regex(glob: str, capture: bool = False) -> str:
    """The body of an expression that matches what the glob matches.

    `**` between slashes is any number of folders, at the end anything below, elsewhere anything; `*` and `?` stay within
    a segment. With capture, parentheses group and `**` takes as little as it can.
    """
    glob = normalize_separators(glob)
    lazy = "?" if capture else ""
    out, i = [], 0
    while i < len(glob):
        here = glob[i:]
        if here.startswith("/**/"):
            out.append(f"/(?:.*{lazy}/)?")
            i += 4
        elif here == "/**":
            out.append("(?:/.*)?")
            i += 3
        elif i == 0 and here.startswith("**/"):
            out.append(f"(?:.*{lazy}/)?")
            i += 3
        elif here.startswith("**"):
            out.append(".*" + lazy)
            i += 2
        elif here[0] == "*":
            out.append("[^/]*")
            i += 1
        elif here[0] == "?":
            out.append("[^/]")
            i += 1
        elif here[0] == "[":
            found = _class(glob, i)
            if found is None:
                raise UserError(f"a character class is never closed in {glob!r}")
            out.append(found[0])
            i = found[1]
        elif capture and here[0] in "()":
            out.append(here[0])
            i += 1
        else:
            out.append(_literal(here[0]))
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    source: str
    body: str
    syntax: str = GLOB
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        """For Java: whole input, `.` matches all but a line feed, `$` is not used since it forgives a final one."""
        return f"(?d{'iu' if self.ignore_case else ''})^(?:{self.body})\\z"

    @property
    def re2(self) -> str:
        """The same for an oracle whose engine is RE2."""
        return f"{'(?i)' if self.ignore_case else ''}^(?:{self.body})$"

    def matches(self, col: Column) -> Column:
        """Simple shapes become comparisons, which a scan can push down."""
        if self.syntax == LITERAL:
            said = normalize_separators(self.source)
            return F.lower(col) == said.lower() if self.ignore_case else col == F.lit(said)
        if self.syntax == GLOB and not self.ignore_case:
            said = normalize_separators(self.source)
            plain = lambda s: not re.search(r"[*?\[\]()]", s)
            if plain(said):
                return col == F.lit(said)
            if said == "**":
                return ~F.contains(col, F.lit("\n"))
            if said.endswith("/**") and said[:-3] and plain(said[:-3]):
                return (col == F.lit(said[:-3])) | (col.startswith(said[:-2]) & ~F.contains(col, F.lit("\n")))
        return col.rlike(self.regex)

    def capture(self, col: Column) -> Column:
        """The captured text, null where nothing or nothing but emptiness was captured."""
        return F.nullif(F.regexp_extract(col, self.regex, 1), F.lit(""))


def compile_pattern(source: str, syntax: str = GLOB, ignore_case: bool = False, capture: bool = False) -> Pattern:
    if not source.strip():
        raise UserError("a pattern must not be empty")
    if syntax == GLOB:
        body = glob_to_regex(source, capture)
    elif syntax == REGEX:
        body = source
    elif syntax == LITERAL:
        body = "".join(_literal(ch) for ch in normalize_separators(source))
    else:
        raise UserError(f"unknown pattern syntax {syntax!r}")
    try:
        groups = re.compile(body).groups
    except re.error as e:
        raise UserError(f"pattern {source!r}: {e}") from e
    if capture and groups != 1:
        raise UserError(f"pattern {source!r} needs exactly one capture group, it has {groups}")
    return Pattern(source, body, syntax, ignore_case)


@dataclass(frozen=True)
class Filter:
    """A pattern on one part of an identifier, with a polarity and exclusions."""

    pattern: Pattern
    target: str = "path"
    matching: bool = True
    exclusions: tuple[Filter, ...] = ()

    def excluding(self, *filters: Filter) -> Filter:
        return replace(self, exclusions=self.exclusions + filters)

    def not_matching(self) -> Filter:
        """Polarity turned; exclusions still exclude."""
        return replace(self, matching=not self.matching)

    def column(self, identifier: Column) -> Column:
        hit = self.pattern.matches(TARGETS[self.target](identifier))
        out = (identifier != "") & (hit if self.matching else ~hit)
        for x in self.exclusions:
            out = out & ~x.column(identifier)
        return out

    def _plain(self, other: Filter) -> bool:
        return other.target == self.target and other.matching and not other.exclusions

    def __str__(self) -> str:
        out = f'{self.target} {"matches" if self.matching else "does not match"} "{self.pattern.source}"'
        before = None
        for x in self.exclusions:
            listed = before is not None and self._plain(x) and self._plain(before)
            out += (", " if listed else ", excluding ") + (f'"{x.pattern.source}"' if self._plain(x) else str(x))
            before = x
        return out


@dataclass(frozen=True)
class Patterns:
    """Makes filters of one syntax and case rule."""

    syntax: str = GLOB
    ignore_case: bool = False

    def compile(self, pattern: str) -> Pattern:
        return compile_pattern(pattern, self.syntax, self.ignore_case)

    def filter(self, pattern: str, target: str) -> Filter:
        return Filter(self.compile(pattern), target)

    def filename(self, pattern: str) -> Filter:
        return self.filter(pattern, "filename")

    def folder(self, pattern: str) -> Filter:
        return self.filter(pattern, "path without filename")

    def path(self, pattern: str) -> Filter:
        return self.filter(pattern, "path")

    def classname(self, pattern: str) -> Filter:
        return self.filter(pattern, "classname")

    def file(self, path: str) -> Filter:
        """One file by its exact path, whatever the syntax."""
        return Filter(compile_pattern(path, LITERAL, self.ignore_case), "path")


@dataclass(frozen=True)
class Selection:
    """Filters that all (or any) must hold; none selects everything."""

    filters: tuple[Filter, ...] = ()
    any_of: bool = False

    def add(self, f: Filter) -> Selection:
        return replace(self, filters=(*self.filters, f))

    def excepting(self, *exclusions: Filter) -> Selection:
        """Exclusions qualify the last filter alone, and speak of the same population."""
        if not self.filters:
            raise UserError("an exclusion needs a selector before it")
        if not exclusions:
            raise UserError("an exclusion needs at least one pattern")
        last = self.filters[-1]
        for x in exclusions:
            if (x.target == "classname") != (last.target == "classname"):
                raise UserError(f"{x.target} cannot qualify a selector on {last.target}")
        return replace(self, filters=(*self.filters[:-1], last.excluding(*exclusions)))

    def column(self, identifier: Column) -> Column:
        if not self.filters:
            return F.lit(True)
        return reduce(Column.__or__ if self.any_of else Column.__and__, (f.column(identifier) for f in self.filters))

    def __str__(self) -> str:
        return (" or " if self.any_of else ", ").join(map(str, self.filters))

    def __bool__(self) -> bool:
        return bool(self.filters)


@dataclass(frozen=True)
class Mood:
    negated: bool = False

    def holds(self, satisfied: Column) -> Column:
        return satisfied != F.lit(self.negated)

    def __str__(self) -> str:
        return "should not" if self.negated else "should"


SHOULD, SHOULD_NOT = Mood(False), Mood(True)
