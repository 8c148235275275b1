"""Relabelling and grouping of edges, the operator everything else is built on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Mapping:
    """Labels for an edge's two ends; a null or empty label, or a condition that fails, drops the edge."""

    source: Column
    target: Column
    where: Column | None = None
    #: whether pairs of equal labels go
    apart: bool = False

    def apply(self, edges: DataFrame) -> DataFrame:
        kept = edges if self.where is None else edges.where(self.where)
        out = labelled(kept, source_label=self.source, target_label=self.target)
        out = out.where("source_label <> '' and target_label <> ''")  # nulls fail too
        return out.where("source_label <> target_label") if self.apart else out


def labelled(edges: DataFrame, **labels: Column) -> DataFrame:
    """edges with labels, each evaluated once an edge: conditions on them would else be pushed down as copies of their expressions."""
    made = F.inline(F.array(F.struct(*[c.alias(k) for k, c in labels.items()])))
    return edges.select("*", made)


def _ends() -> tuple[Column, Column]:
    return F.col("source"), F.col("target")


def identity() -> Mapping:
    return Mapping(*_ends())


def per_edge() -> Mapping:
    s, t = _ends()
    return Mapping(s, t, s != t)


def per_internal_edge() -> Mapping:
    s, t = _ends()
    return Mapping(s, t, ~F.col("external") & (s != t))


def per_external_edge() -> Mapping:
    s, t = _ends()
    return Mapping(s, t, F.col("external") & (s != t))


def gathered(labelled: DataFrame, cumulate: bool = False) -> DataFrame:
    """Labelled edges by their pair of labels: the count, and (with cumulate) the edges, sorted."""
    raw = F.struct("source", "target", "external", "import_kinds")
    what = [F.count(F.lit(1)).alias("count")]
    if cumulate:
        what.append(F.array_sort(F.collect_list(raw)).alias("cumulated"))
    return labelled.groupBy("source_label", "target_label").agg(*what)


def project_all(edges: DataFrame, mapping: Mapping, cumulate: bool = False) -> DataFrame:
    """source_label, target_label, count of edges behind, and (with cumulate) those edges, sorted."""
    return gathered(mapping.apply(edges), cumulate)


def apart(mapping: Mapping) -> Mapping:
    """The mapping without pairs of equal labels."""
    return replace(mapping, apart=True)


def project_edges(edges: DataFrame, mapping: Mapping, cumulate: bool = False) -> DataFrame:
    """project_all without pairs of equal labels; the filter stands before the grouping."""
    return project_all(edges, apart(mapping), cumulate)


def project_nodes(edges: DataFrame, mapping: Mapping) -> DataFrame:
    """label, incoming and outgoing labels, sorted. A pair of equal labels makes the node alone."""
    pairs = mapping.apply(edges).select("source_label", "target_label").distinct()
    # One row for each end of each pair, so both directions are gathered in one grouping.
    ends = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("source_label").alias("label"), F.col("target_label").alias("o"), F.lit(None).cast("string").alias("i")),
                F.struct(F.col("target_label").alias("label"), F.lit(None).cast("string").alias("o"), F.col("source_label").alias("i")),
            )
        )
    )
    other = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) != F.col("label"), F.col(c))))
    return ends.groupBy("label").agg(other("i").alias("incoming"), other("o").alias("outgoing"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """label -> successors, sorted; labels that only receive have none."""
    step = lambda label, to: F.struct(F.col(label).alias("label"), to.cast("string").alias("to"))
    ends = F.array(step("source_label", F.col("target_label")), step("target_label", F.lit(None)))
    both = pairs.select(F.inline(ends))
    return both.groupBy("label").agg(F.array_sort(F.collect_set("to")).alias("successors"))
