"""Slash-separated identifiers: cleaning, and the parts that patterns look at."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: str) -> str:
    """Shortest equal path: no doubled slashes, no `.`, `..` resolved where possible; empty gives `.`."""
    out = posixpath.normpath(path or ".")
    return "/" + out.lstrip("/") if out.startswith("//") else out


def normalize(identifier: str) -> str:
    """Blanks trimmed, backslashes turned, cleaned; blank alone stays empty."""
    said = identifier.strip().replace("\\", "/")
    return clean(said) if said else ""


def normalized(col: Column) -> Column:
    """normalize() as a column. Only identifiers that are not clean already are taken apart."""
    turned = F.replace(F.regexp_replace(col, r"^(?U:\s+)|(?U:\s+)\z", ""), F.lit("\\"), F.lit("/"))
    tidy = ~turned.rlike(r"//|(?:^|/)\.{1,2}(?:/|\z)|.(?s:)/\z")
    rooted = turned.startswith("/")
    segments = F.filter(F.split(turned, "/"), lambda x: (x != "") & (x != "."))

    def stepped(kept: Column, x: Column) -> Column:
        upward = (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != "..")
        above = F.when(rooted, kept).otherwise(F.array_append(kept, x))
        return F.when(x != "..", F.array_append(kept, x)).when(upward, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(above)

    kept = F.aggregate(segments, F.array().cast("array<string>"), stepped)
    body = F.array_join(kept, "/")
    return F.when(tidy, turned).when(rooted, F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def separated(col: Column) -> Column:
    """Blanks trimmed, backslashes turned, doubled slashes and a final one taken out: what a glob is matched with."""
    return F.regexp_replace(F.regexp_replace(F.trim(col), r"[/\\]+", "/"), r"(?<=.)/\z", "")


def relative(root: str, target: str) -> str | None:
    """target as seen from root; None if it lies outside."""
    root, target = normalize(root), normalize(target)
    if not root or not target or root.startswith("/") != target.startswith("/"):
        return None
    said = posixpath.relpath(target, root) if root.startswith("/") else posixpath.relpath("/" + target, "/" + root)
    return None if said == ".." or said.startswith("../") else said


def base(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def folder(col: Column) -> Column:
    """All before the last slash; `.` at the root."""
    return F.when(F.instr(col, "/") == 0, F.lit(".")).otherwise(F.left(col, F.length(col) - F.length(F.substring_index(col, "/", -1)) - F.lit(1)))


def classname(col: Column) -> Column:
    """What follows the last dot of the last segment."""
    return F.element_at(F.split(base(col), r"\."), -1)


def stem(col: Column) -> Column:
    """The last segment without its last extension."""
    return F.regexp_replace(base(col), r"\.[^.]*\z", "")


def extension(col: Column) -> Column:
    return F.regexp_extract(base(col), r"(\.[^.]*)\z", 1)
