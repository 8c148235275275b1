"""Neighbourhoods and closures by frontier expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import Scratch

FORWARD, BACKWARD, BOTH = "forward", "backward", "both"


def links_of(edges: DataFrame, towards: str) -> DataFrame:
    """src, dst: the steps that a direction allows."""
    there = edges.where("source <> target").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {FORWARD: there, BACKWARD: back, BOTH: there.union(back)}[towards]


def reach(edges: DataFrame, seeds: DataFrame, towards: str, depth: int | None = None) -> DataFrame:
    """node: the seeds and what lies within depth steps of them (any number if None, a negative depth counts as 0).

    Each round joins the last frontier with the links and takes away what was visited. Rounds are written to the shared
    folder, so no plan grows and a lost executor repeats one round; only whether a frontier is empty comes to the driver.
    """
    seeds = seeds.select("node").distinct()
    if depth is not None and depth <= 0:
        return seeds
    scratch = Scratch(edges.sparkSession)
    links = scratch.write(links_of(edges, towards))  # each round's step is distinct, so links need not be
    frontier = scratch.write(seeds)
    visited = [frontier]
    done = 0
    while depth is None or done < depth:
        seen = visited[0]
        for v in visited[1:]:
            seen = seen.union(v)
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = scratch.write(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited.append(frontier)
        if len(visited) > 16:  # long chains: keep the union short
            merged = visited[0]
            for v in visited[1:]:
                merged = merged.union(v)
            visited = [scratch.write(merged)]
        done += 1
    out = visited[0]
    for v in visited[1:]:
        out = out.union(v)
    return out
