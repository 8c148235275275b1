"""Strongly connected components and elementary circuits of projected edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.storage import Scratch, ship_package

DEFAULT_CIRCUITS = 1000
#: Edges up to which components are found by one task in memory; this many rows are some megabytes.
SMALL_GRAPH = 200_000


def components_in_memory(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """label -> least label of its component, by depth-first search without recursion."""
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    open_, on, found = [], set(), {}
    for root in sorted(out):
        if root in order:
            continue
        path = [(root, iter(out[root]))]
        order[root] = low[root] = len(order)
        open_.append(root)
        on.add(root)
        while path:
            here, rest = path[-1]
            for to in rest:
                if to not in order:
                    order[to] = low[to] = len(order)
                    open_.append(to)
                    on.add(to)
                    path.append((to, iter(out[to])))
                    break
                if to in on:
                    low[here] = min(low[here], order[to])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[here])
                if low[here] == order[here]:
                    members = []
                    while not members or members[-1] != here:
                        members.append(open_.pop())
                    on.difference_update(members)
                    least = min(members)
                    found |= dict.fromkeys(members, least)
    return found


def strong_components(pairs: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """label, scc (the component's least label) for the labels of components of two and more.

    First labels without a way in or out are trimmed, again and again. What remains is solved in one task if it is small;
    else by rounds: every open label takes the least label that reaches it (forward), and from each label that kept its own
    name the labels that reach it back with that name are its component. Rounds are written to the shared folder; those of a
    graph that is not small are over numbers in the labels' order, so that strings are shuffled when they are numbered only.
    """
    ship_package(pairs.sparkSession)
    scratch = Scratch(pairs.sparkSession)
    e = scratch.write(pairs.select(F.col("source_label").alias("a"), F.col("target_label").alias("b")).where("a <> b").distinct())
    n = e.count()
    if 0 < n <= small:
        return _solve_small(e)
    names, e = _numbered(scratch, e)
    found = scratch.write(_in_rounds(scratch, e, n, small))
    label, scc = names.select(F.col("i").alias("label"), F.col("id").alias("l")), names.select(F.col("i").alias("scc"), F.col("id").alias("s"))
    return found.join(label, "label").join(scc, "scc").select(F.col("l").alias("label"), F.col("s").alias("scc"))


def _numbered(scratch: Scratch, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, i: labels with numbers in their order, the edges by numbers)."""
    labels = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = labels.repartitionByRange(parts, "id").sortWithinPartitions("id")
    names = scratch.write(ranged.withColumn("i", F.monotonically_increasing_id()))  # a part's labels come before the next part's
    by = e.join(names.select(F.col("id").alias("a"), F.col("i").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("i").alias("y")), "b")
    return names, scratch.write(by.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _in_rounds(scratch: Scratch, e: DataFrame, n: int, small: int) -> DataFrame:
    found = None
    while n:
        if n <= small:
            return _with(found, _solve_small(e))
        while n:  # trim
            left = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            left = scratch.write(left.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            e, before, n = left, n, left.count()
            if n > 0.95 * before:
                break
        if n <= small:
            continue
        colour = _spread(scratch, e, None)
        back = e.join(colour.withColumnsRenamed({"id": "a", "c": "ca"}), "a").join(colour.withColumnsRenamed({"id": "b", "c": "cb"}), "b").where("ca = cb").select("a", "b")
        marks = _spread(scratch, back.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.where("id = c").select("id", "c"))
        done = scratch.write(marks.select(F.col("id").alias("label"), F.col("c").alias("scc")))
        found = _with(found, done)
        rest = e.join(done.select(F.col("label").alias("a")), "a", "left_anti").join(done.select(F.col("label").alias("b")), "b", "left_anti")
        e = scratch.write(rest.select("a", "b"))
        n = e.count()
    none = e.sparkSession.createDataFrame([], "label bigint, scc bigint")
    found = none if found is None else found
    return found.join(found.groupBy("scc").count().where("count > 1").select("scc"), "scc", "left_semi").select("label", "scc")


def _with(found: DataFrame | None, more: DataFrame) -> DataFrame:
    if found is None:
        return more
    out = found.unionByName(more)
    return out.join(out.groupBy("scc").count().where("count > 1").select("scc"), "scc", "left_semi").select("label", "scc")


def _solve_small(e: DataFrame) -> DataFrame:
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for b in batches for p in zip(b["a"], b["b"])]
        found = components_in_memory(rows)
        sizes: dict[str, int] = {}
        for c in found.values():
            sizes[c] = sizes.get(c, 0) + 1
        kept = sorted((x, c) for x, c in found.items() if sizes[c] > 1)
        yield pd.DataFrame(kept, columns=["label", "scc"], dtype=object if strings else "int64")

    kind = e.schema["a"].dataType.simpleString()
    strings = kind == "string"
    return e.coalesce(1).mapInPandas(solve, f"label {kind}, scc {kind}")


def _spread(scratch: Scratch, e: DataFrame, start: DataFrame | None) -> DataFrame:
    """id, c: the least mark that reaches each label along a -> b; without a start every label marks itself."""
    if start is None:
        start = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("c", F.col("id"))
    marks = scratch.write(start.select("id", "c", F.lit(True).alias("new")))
    while True:
        moved = e.join(marks.where("new").select(F.col("id").alias("a"), "c"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("m"))
        joined = marks.select("id", "c").join(moved, "id", "full_outer")
        better = F.col("m").isNotNull() & (F.col("c").isNull() | (F.col("m") < F.col("c")))
        marks = scratch.write(joined.select("id", F.when(better, F.col("m")).otherwise(F.col("c")).alias("c"), better.alias("new")))
        if marks.where("new").isEmpty():
            return marks.select("id", "c")


def cyclic_components(pairs: DataFrame) -> DataFrame:
    """scc, members: components of two and more with their sorted labels."""
    return strong_components(pairs).groupBy("scc").agg(F.array_sort(F.collect_list("label")).alias("members"))


def cycle_edges(pairs: DataFrame) -> DataFrame:
    """The pairs whose two labels lie in one component, with that component."""
    parts = strong_components(pairs)
    a = parts.select(F.col("label").alias("source_label"), F.col("scc").alias("scc"))
    b = parts.select(F.col("label").alias("target_label"), F.col("scc").alias("scc_b"))
    return pairs.where("source_label <> target_label").join(a, "source_label").join(b, "target_label").where("scc = scc_b").drop("scc_b")


def elementary_circuits(pairs: list[tuple[str, str]], limit: int | None) -> Iterator[list[str]]:
    """Circuits of one component, each once from its least label, roots in order and successors in order, at most limit.

    From each root the search goes only through labels that are not less and can still get back to it; a label from which a
    try has failed stays closed until a circuit goes through one of its successors.
    """
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        if a != b:
            after.setdefault(a, []).append(b)
    emitted = 0
    for root in sorted(after):
        inside = components_in_memory([(a, b) for a in after if a >= root for b in after[a] if b >= root])
        if root not in inside:
            continue
        ways = {a: [b for b in after.get(a, ()) if b >= root and inside.get(b) == inside[root]] for a in inside if inside[a] == inside[root]}
        closed: set[str] = {root}
        waiting: dict[str, set[str]] = {}
        path, rest, hit = [root], [iter(ways[root])], [False]

        def reopen(label: str) -> None:
            todo = [label]
            while todo:
                x = todo.pop()
                if x in closed:
                    closed.discard(x)
                    todo += waiting.pop(x, ())

        while path:
            for to in rest[-1]:
                if to == root:
                    if limit is not None and emitted >= limit:
                        return
                    emitted += 1
                    yield list(path)
                    hit[-1] = True
                elif to not in closed:
                    path.append(to)
                    closed.add(to)
                    rest.append(iter(ways[to]))
                    hit.append(False)
                    break
            else:
                label, success = path.pop(), hit.pop()
                rest.pop()
                if success:
                    reopen(label)
                    if hit:
                        hit[-1] = True
                else:
                    for to in ways[label]:
                        waiting.setdefault(to, set()).add(label)


@dataclass(frozen=True)
class Circuits:
    """circuits: circuit_id (from 1), length, labels, by length then labels. complete: none was cut off by the limit."""

    circuits: DataFrame
    complete: DataFrame


def project_circuits(pairs: DataFrame, max_circuits: int = 0) -> Circuits:
    """Elementary circuits of all components under one limit (0: 1000, negative: none), consumed in order of the components' members.

    A component is one pandas group: the limit bounds what it gives, and a component's edges what it holds. Each has a
    circuit, so components are searched in order, some at a time, until the limit is exceeded.
    """
    limit = None if max_circuits < 0 else max_circuits or DEFAULT_CIRCUITS
    pairs = Scratch(pairs.sparkSession).write(pairs.select("source_label", "target_label"))
    inner = cycle_edges(pairs).select("scc", "source_label", "target_label")

    def enumerate_(key, group: pd.DataFrame) -> pd.DataFrame:
        found = elementary_circuits(list(zip(group["source_label"], group["target_label"])), None if limit is None else limit + 1)
        rows = [(key[0], i, c) for i, c in enumerate(found)]
        return pd.DataFrame(rows, columns=["scc", "at", "labels"])

    def search(edges: DataFrame) -> DataFrame:
        # A written table: the enumeration runs once for the list and the flag.
        return scratch.write(edges.groupBy("scc").applyInPandas(enumerate_, "scc string, at int, labels array<string>"))

    scratch = Scratch(pairs.sparkSession)
    if limit is None:
        every = kept = search(inner)
    else:
        # Components have no label in common, so their least labels order them as their members do.
        inner = scratch.write(inner)
        order = [r["scc"] for r in inner.select("scc").distinct().orderBy("scc").limit(limit + 1).collect()]
        at, step, total, some = 0, 1, 0, []
        while total <= limit and at < len(order):
            first, last = order[at], order[min(at + step, len(order)) - 1]
            some.append(search(inner.where(F.col("scc").between(first, last))))
            total += some[-1].count()
            at, step = at + step, step * 4
        every = some[0] if some else search(inner)
        for more in some[1:]:
            every = every.unionByName(more)
        # ranked without the lists, so no task holds more of them than are kept
        ranked = every.select("scc", "at").withColumn("k", F.row_number().over(W.orderBy("scc", "at"))).where(F.col("k") <= limit)
        kept = every.join(F.broadcast(ranked), ["scc", "at"])
    listed = kept.select(F.size("labels").alias("length"), "labels")
    listed = listed.select(F.row_number().over(W.orderBy("length", "labels")).alias("circuit_id"), "length", "labels")
    total = every.agg(F.count(F.lit(1)).alias("n"))
    return Circuits(listed.orderBy("circuit_id"), total.select((F.lit(True) if limit is None else F.col("n") <= limit).alias("complete")))
