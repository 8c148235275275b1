"""Snapshots of a graph: widened, narrowed, collapsed, summed up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.identifiers import folder
from weftgraph.functions.patterns import Filter
from weftgraph.operators import graph
from weftgraph.operators.projection import labelled
from weftgraph.operators.reach import BACKWARD, BOTH, FORWARD, reach


@dataclass(frozen=True)
class Narrowing:
    """Keep what is within depth steps of the nodes that seeds matches (None: any number)."""

    seeds: Filter
    towards: str
    depth: int | None = None


@dataclass(frozen=True)
class SnapshotOptions:
    external: bool = False
    self_dependencies: bool = False
    narrowing: tuple[Narrowing, ...] = ()
    groups: tuple[tuple[str, Filter], ...] = ()
    folder_depth: int = 0
    title: str = ""


@dataclass(frozen=True)
class Snapshot:
    """nodes: label, external. edges: source, target, count, external, import_kinds. summary: one row of counts."""

    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame
    title: str = ""


def label_of(identifier: Column, external: Column, options: SnapshotOptions) -> Column:
    """The first group that matches; else, for an own node, its first folder segments; else itself."""
    out = None
    for name, f in options.groups:
        out = F.when(f.column(identifier), name) if out is None else out.when(f.column(identifier), name)
    rest = identifier
    if options.folder_depth > 0:
        cut = F.array_join(F.slice(F.split(folder(identifier), "/"), 1, options.folder_depth), "/")
        rest = F.when(external, identifier).otherwise(cut)
    return rest if out is None else out.otherwise(rest)


def project_snapshot(edges: DataFrame, options: SnapshotOptions) -> Snapshot:
    """The order in which modifiers were given does not matter: all narrowings must keep a node."""
    base = edges if options.external else edges.where(~F.col("external"))
    links = graph.dependencies(base)
    own = graph.own_nodes(base).withColumn("external", F.lit(False))
    universe = own
    if options.external:
        outside = links.where("external").select(F.col("target").alias("node")).distinct().join(own.select("node"), "node", "left_anti")
        universe = own.unionByName(outside.withColumn("external", F.lit(True)))
    kept = universe
    for n in options.narrowing:
        seeds = universe.where(n.seeds.column(F.col("node"))).select("node")
        kept = kept.join(reach(links, seeds, n.towards, n.depth), "node", "left_semi")
    label = lambda id_, ext: label_of(F.col(id_), F.col(ext), options)
    nodes = kept.select(label("node", "external").alias("label"), "external").groupBy("label").agg(F.bool_and("external").alias("external"))
    if options.narrowing:
        for end in ("source", "target"):
            links = links.join(kept.select(F.col("node").alias(end)), end, "left_semi")
    # A source is always a node of one's own; a target's own flag decides how it is labelled.
    named = labelled(links, s=label_of(F.col("source"), F.lit(False), options), t=label("target", "external"))
    named = named.select("s", "t", "external", "import_kinds")
    if not options.self_dependencies:
        named = named.where("s <> t")
    grouped = named.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(
        F.count(F.lit(1)).alias("count"), F.bool_or("external").alias("external"), F.bit_or("import_kinds").cast("int").alias("import_kinds")
    )
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("external").alias("external_nodes"))
    e = grouped.agg(
        F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("count"), F.lit(0)).alias("dependencies"), F.count_if("external").alias("external_edges")
    )
    summary = n.join(F.broadcast(e), F.lit(True)).select("nodes", "edges", "dependencies", "external_nodes", "external_edges")  # one row each
    return Snapshot(nodes, grouped, summary, options.title)


__all__ = ["BACKWARD", "BOTH", "FORWARD", "Narrowing", "Snapshot", "SnapshotOptions", "project_snapshot"]
