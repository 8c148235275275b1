"""The four kinds of import as bits of an integer column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds in the order of their bits.
KINDS = ("plain", "aliased", "blank", "dot")
BIT = {name: 1 << i for i, name in enumerate(KINDS)}
ALL = (1 << len(KINDS)) - 1


def mask(*kinds: str) -> int:
    return reduce(int.__or__, (BIT[k] for k in kinds), 0)


def with_kinds(col: Column, *kinds: str) -> Column:
    return col.bitwiseOR(F.lit(mask(*kinds)))


def union(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def has(col: Column, kind: str) -> Column:
    return col.bitwiseAND(F.lit(BIT[kind])) != 0


def is_empty(col: Column) -> Column:
    return col.bitwiseAND(F.lit(ALL)) == 0


def count(col: Column) -> Column:
    return F.bit_count(col.bitwiseAND(F.lit(ALL)))


def names(col: Column) -> Column:
    """The kinds in a set as an array, in the order of their bits."""
    return F.filter(F.array(*[F.when(has(col, k), F.lit(k)) for k in KINDS]), lambda x: x.isNotNull())


def decode(bits: int) -> list[str]:
    return [k for k in KINDS if bits & BIT[k]]
