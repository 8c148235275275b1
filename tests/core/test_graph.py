import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.errors import EmptySnapshotError, UserError
from weftgraph.functions.patterns import Patterns
from weftgraph.operators import components as C
from weftgraph.operators import graph, projection
from weftgraph.operators.reach import BACKWARD, BOTH, FORWARD, reach
from weftgraph.options import CheckOptions
from weftgraph.plans.graph import project_graph

# Numbers from 2 to 13 by folder; each depends on its proper divisors but 1, primes on a module outside.
NUMBERS = range(2, 14)


def name(n):
    return f"math/{'odd' if n % 2 else 'even'}/n{n:02}.go"


INNER = {(name(n), name(d)) for n in NUMBERS for d in NUMBERS if d < n and n % d == 0}
PRIMES = [n for n in NUMBERS if all(n % d for d in range(2, n))]
FILES = [name(n) for n in NUMBERS]
EDGES = [(a, b, False, "plain") for a, b in sorted(INNER)] + [(name(n), "lib/primes", True, "blank") for n in PRIMES]


def folder_of(x):
    return x.rpartition("/")[0]


@pytest.fixture(scope="module")
def edges(spark):
    return graph.create_edges(spark, [(f, f) for f in FILES] + EDGES).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_canonical(spark):
    e = graph.create_edges(spark, [("a\\x.go", "./b", False, "plain"), ("a/x.go", "b", True, "dot"), ("", "b"), ("c", "c", True, "plain"), ("a", "Net ", True)])
    assert rows(e, "source", "target", "external", "import_kinds") == [("a", "Net", True, 0), ("a/x.go", "b", True, 9), ("c", "c", False, 0)]
    assert rows(graph.find(e, "a\\x.go", "b"), "external") == [(True,)] and graph.find(e, "b", "a/x.go").count() == 0
    assert rows(graph.nodes(e), "node") == [("Net",), ("a",), ("a/x.go",), ("b",), ("c",)]
    assert rows(graph.add(e, e), "source", "target") == rows(e, "source", "target")


def test_projections(edges):
    folder = projection.Mapping(F.regexp_replace("source", "/[^/]*$", ""), F.regexp_replace("target", "/[^/]*$", ""), ~F.col("external"))
    pairs = projection.project_edges(edges, folder, cumulate=True).collect()
    want = {}
    for a, b in INNER:
        if folder_of(a) != folder_of(b):
            want.setdefault((folder_of(a), folder_of(b)), []).append((a, b))
    assert {(r["source_label"], r["target_label"]): [(x["source"], x["target"]) for x in r["cumulated"]] for r in pairs} == {k: sorted(v) for k, v in want.items()}
    assert all(r["count"] == len(r["cumulated"]) for r in pairs)
    n = {r["label"]: (r["incoming"], r["outgoing"]) for r in projection.project_nodes(edges, projection.identity()).collect()}
    assert n[name(6)] == ([name(12)], sorted([name(2), name(3)])) and n["lib/primes"] == (sorted(map(name, PRIMES)), [])
    assert n[name(13)] == ([], ["lib/primes"])
    assert projection.project_all(edges, projection.per_external_edge()).count() == len(PRIMES)
    assert projection.project_all(edges, projection.per_edge()).count() == len(EDGES)
    assert projection.project_all(edges, projection.per_internal_edge()).count() == len(INNER)
    drop = projection.Mapping(F.when(F.col("source") == name(12), "dozen"), F.col("target"))
    assert rows(projection.project_all(edges, drop), "source_label") == [("dozen",)] * 5


def brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach_ = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach_[n]:
                    reach_[n].add(b)
    return {n: min(m for m in nodes if m in reach_[n] and n in reach_[m]) for n in nodes if any(m != n and m in reach_[n] and n in reach_[m] for m in nodes)}


def brute_circuits(pairs):
    nodes, have, out = sorted({x for p in pairs for x in p}), set(pairs), set()
    for k in range(2, len(nodes) + 1):
        for c in itertools.permutations(nodes, k):
            if c[0] == min(c) and all((c[i], c[(i + 1) % k]) in have for i in range(k)):
                out.add(c)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_and_circuits_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = "abcdefg"
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(13)})
    df = spark.createDataFrame(pairs, "source_label string, target_label string")
    want = brute_scc([p for p in pairs if p[0] != p[1]])
    for small in (C.SMALL_GRAPH, 0):  # in one task, and by label propagation
        assert dict(map(tuple, C.strong_components(df, small).collect())) == want, small
    real = [p for p in pairs if p[0] != p[1]]
    found = C.project_circuits(df)
    assert {tuple(r["labels"]) for r in found.circuits.collect()} == brute_circuits(real)
    assert found.complete.first()[0]


def complete(n):
    return [(a, b) for a in "abcdefgh"[:n] for b in "abcdefgh"[:n] if a != b]


def test_circuit_counts_and_limits(spark):
    assert [len(list(C.elementary_circuits(complete(n), None))) for n in (2, 3, 4, 5, 7)] == [1, 5, 20, 84, 2365]
    assert len(list(C.elementary_circuits(complete(7), 1000))) == 1000
    df = spark.createDataFrame(complete(7) + [("x", "y"), ("y", "x")], "source_label string, target_label string")
    found = C.project_circuits(df)
    listed = found.circuits.collect()
    assert len(listed) == 1000 and not found.complete.first()[0]
    assert [(r["length"], r["labels"]) for r in listed] == sorted((r["length"], r["labels"]) for r in listed)
    all_ = C.project_circuits(df, -1)
    assert all_.circuits.count() == 2366 and all_.complete.first()[0]
    assert rows(C.cyclic_components(df), "scc") == [("a",), ("x",)]
    assert C.cycle_edges(df).count() == 44
    assert ("a", "c", "d", "b") in {tuple(c) for c in C.elementary_circuits([("a", "b"), ("b", "a"), ("b", "d"), ("d", "b"), ("a", "c"), ("c", "d")], None)}


def test_reach(spark, edges):
    one = spark.createDataFrame([(name(6),)], "node string")
    inner = edges.where("not external")
    assert rows(reach(inner, one, FORWARD), "node") == sorted((name(n),) for n in (2, 3, 6))
    assert rows(reach(inner, one, BACKWARD), "node") == sorted((name(n),) for n in (6, 12))
    assert rows(reach(inner, one, BOTH, 1), "node") == sorted((name(n),) for n in (2, 3, 6, 12))
    assert rows(reach(inner, one, BOTH, -1), "node") == [(name(6),)]
    ring = spark.createDataFrame([(str(i), str((i + 1) % 40), False, 0) for i in range(40)], graph.SCHEMA)
    assert reach(ring, spark.createDataFrame([("0",)], "node string"), FORWARD).count() == 40


def test_snapshots(edges):
    g = project_graph(edges)
    s = g.snapshot()
    assert rows(s.nodes, "label") == sorted((f,) for f in FILES) and tuple(s.summary.first()) == (len(FILES), len(INNER), len(INNER), 0, 0)
    s = g.including_external_dependencies().snapshot()
    all_ = len(INNER) + len(PRIMES)
    assert tuple(s.summary.first()) == (len(FILES) + 1, all_, all_, 1, len(PRIMES))
    across = Counter((folder_of(a), folder_of(b)) for a, b in INNER)
    s = g.collapse_to_folder_depth(2).snapshot()
    assert rows(s.nodes, "label") == [("math/even",), ("math/odd",)]
    assert rows(s.edges, "source", "target", "count") == sorted((a, b, n) for (a, b), n in across.items() if a != b)
    s = g.collapse_to_folder_depth(2).including_self_dependencies().snapshot()
    assert rows(s.edges, "source", "target", "count") == sorted((a, b, n) for (a, b), n in across.items())
    s = g.including_external_dependencies().collapse_by_pattern("books", "lib/**").collapse_by_pattern("numbers", "**").except_(name(7)).snapshot()
    assert rows(s.nodes, "label", "external") == [("books", True), (name(7), False), ("numbers", False)]
    near = {6, 2, 3, 12} & ({2} | {n for n in NUMBERS if n % 2 == 0})
    assert rows(g.focus_on(name(6), 1).dependents_of(name(2)).snapshot().nodes, "label") == sorted((name(n),) for n in near)


def test_report_errors_and_sentences(edges):
    g = project_graph(edges)
    assert str(g.focus_on("math/odd/*", 0)) == 'project graph, focus on path matches "math/odd/*" within 0 hops'
    said = g.including_external_dependencies().focus_on("**/n12.go", 1).titled("twelve and its divisors")
    assert str(said) == 'project graph, including external dependencies, focus on path matches "**/n12.go" within 1 hop, titled "twelve and its divisors"'
    with pytest.raises(EmptySnapshotError):
        g.focus_on("zero", 1).snapshot()
    assert g.focus_on("zero", 1).with_check_options(CheckOptions(allow_empty_tests=True)).snapshot().nodes.count() == 0
    bad = g.collapse_to_folder_depth(0).focus_on("[", 1)
    assert "rejected" in str(bad) and "depth of 0" in str(bad)
    with pytest.raises(UserError, match="depth of 0"):
        bad.to_dot()
    with pytest.raises(UserError):
        g.except_("x").snapshot()
    assert project_graph(edges, Patterns(ignore_case=True)).focus_on("MATH/Even/N02.GO", 0).snapshot().nodes.count() == 1
