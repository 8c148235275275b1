"""What must not come together in one row, one group or one task as tables grow."""

import os

from pyspark.sql import functions as F

from weftgraph import queries
from weftgraph.operators import components as C
from weftgraph.operators import graph, metrics as M, projection
from weftgraph.operators.graph import create_edges
from weftgraph.operators.reach import FORWARD, reach
from weftgraph.plans import metrics as rules_on_metrics
from weftgraph.plans.layers import project_layers
from weftgraph.plans.slices import project_slices
from weftgraph.sources import goproject, testdata
from weftgraph.storage import Scratch

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def trade(spark):
    names = ["a/x1.go", "a/x2.go", "b/y1.go", "b/y2.go", "c/z.go"]
    rows = [(n, n) for n in names] + [("a/x1.go", "b/y1.go"), ("a/x1.go", "b/y2.go"), ("a/x2.go", "b/y1.go"), ("b/y1.go", "c/z.go"), ("c/z.go", "a/x1.go")]
    return create_edges(spark, rows)


def test_tallies_agree_with_lists_and_hold_no_list(spark):
    e = trade(spark)
    policy = project_layers(e).layer("a").defined_by("a/**").layer("b").defined_by("b/**").layer("c").defined_by("c/**")
    policy = policy.where_layer("a").may_not_depend_on_layers("b").where_layer("b").may_only_depend_on_layers()
    slices = project_slices(e).defined_by("(*)/**")
    rules = [policy, slices.should_not().contain_dependency("a", "b"), slices.should().adhere_to_diagram("@startuml\n[a] --> [c]\n[b]\n@enduml")]
    for rule in rules:
        seen = rule.tally()
        assert "collect_list" not in plan(seen)
        key = ["kind", "subject", "object", "finding"]
        want = rule.check().select(*key, F.when(F.col("dependencies").isNotNull(), F.size("dependencies")).cast("long").alias("n"))
        assert sorted(map(repr, seen.select(*key, "n").collect())) == sorted(map(repr, want.collect()))
    assert [r.n for r in rules[0].tally().where("subject = 'a'").collect()] == [3]
    missing = project_layers(e).layer("a").defined_by("nowhere/**").layer("b").defined_by("b/**").where_layer("a").may_not_depend_on_layers("b")
    assert [(r.kind, r.n) for r in missing.tally().collect()] == [("empty-test", None)]


def test_queries_that_count_gather_no_edges(spark):
    if os.path.isdir(SF):
        for name in ("layer_policy", "slice_dependency", "diagram_adherence"):
            assert "collect_list" not in plan(queries.QUERIES[name](spark, SF)), name


def test_counts_and_components_gather_no_members(spark):
    if os.path.isdir(SF):
        for name in ("components", "custom_metric", "satisfaction"):
            text = plan(queries.QUERIES[name](spark, SF))
            assert "order_" not in text and "accessed_by" not in text, name
        assert "lineitem" not in plan(testdata.class_heads(spark, SF)) and "l_orderkey" not in plan(testdata.class_heads(spark, SF))


def test_edges_are_dealt_by_numbers(spark):
    """Lines meet their customer once, by its key, for the merge and the join alike."""
    if os.path.isdir(SF):
        assert "RepartitionByExpression [o_custkey" in plan(testdata.edges(spark, SF))


def test_labels_are_evaluated_once(spark):
    e = trade(spark)
    slow = F.regexp_replace("source", "/.*", ""), F.regexp_replace("target", "/.*", "")
    pairs = projection.project_edges(e, projection.Mapping(*slow))
    assert plan(pairs).count("/.*") == 2
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b", 3), ("b", "c", 1), ("c", "a", 1)]


def test_plain_imports_agree_with_the_parser():
    head = "// x import \"no\"\n\npackage trade // y\n\nimport (\n"
    plain = head + '\t"a/b"\n\t_ "c" //weftgraph:ignore\n  . "d"   // not\n\tñ "e" //weftgraph:ignore audit // later\n)\n\nvar x = `\nimport "z"`\n'
    assert goproject._plain_imports(plain, goproject.DIRECTIVE) == goproject._parsed_imports(plain, goproject.DIRECTIVE)
    assert len(goproject.imports_of(plain)) == 4
    for odd in (
        head + '\t//weftgraph:ignore\n\t"a"\n)\n', head + '\t"a"; "b"\n)\n', head + '\t"a"\n)\nimport "b"\n', head + '\t/* " */ "a"\n)\n', head + '\tfunc "a"\n)\n',
        "package p\nimport `a`\n", "/* import (\n*/package p\nimport (\n\t\"a\"\n)\n", head + '\t"a"\n', "",
    ):
        assert goproject._plain_imports(odd, goproject.DIRECTIVE) is None
        assert goproject.imports_of(odd) == goproject._parsed_imports(odd, goproject.DIRECTIVE)


def test_go_tables_leave_no_cache(spark):
    files = spark.createDataFrame([("a/x.go", "package a\n\ntype T struct {\n\tn int\n}\n"), ("a/y.go", "package a\n\nfunc (t *T) Set() {\n\tt.n = 1\n}\n")], "identifier string, text string")
    counted, classes = goproject.measured_files(files)
    made = goproject.graph_of_files(files, "m")
    assert "InMemoryRelation" not in plan(counted) + plan(classes) + plan(made)
    assert [(r.name, r.method_count, r.fields[0].accessed_by) for r in classes.collect()] == [("T", 1, ["Set"])]


def test_circuits_search_no_more_components_than_are_needed(spark):
    """The list is filled by the first components, so the others are never enumerated."""
    rows = [(f"{k:02}{a}", f"{k:02}{b}") for k in range(12) for a, b in ("ab", "ba", "bc", "cb", "ac", "ca")]
    pairs = spark.createDataFrame(rows, "source_label string, target_label string")
    found = C.project_circuits(pairs, 7)
    assert {x[:2] for r in found.circuits.collect() for x in r.labels} == {"00", "01"}
    assert found.circuits.count() == 7 and not found.complete.first()[0]
    whole = C.project_circuits(pairs, 1000)
    assert whole.circuits.count() == 12 * 5 and whole.complete.first()[0]


def test_large_graphs_go_by_numbers(spark):
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("z", "é"), ("é", "z"), ("a", "z"), ("q", "a")], "source_label string, target_label string")
    got = C.strong_components(pairs, 0)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string"]
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("b", "a"), ("z", "z"), ("é", "z")]


def test_reach_writes_links_without_a_merge(spark, monkeypatch):
    written = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: written.append(plan(df)) or write(self, df))
    found = reach(trade(spark).select("source", "target"), spark.createDataFrame([("b/y1.go",)], "node string"), FORWARD)
    assert written[0].count("Aggregate") == 1  # the test graph's own merge
    assert sorted(r.node for r in found.collect()) == ["a/x1.go", "b/y1.go", "b/y2.go", "c/z.go"]


def test_a_merge_can_be_dealt_and_cleans_each_end_once(spark):
    rows = [(" a\\x/../y ", "b//c", False, 1), ("a/y", "b/c", False, 2), ("a/y", " ext ", True, 4), ("a/y", "a/y", True, 8), ("", "b", False, 1)]
    raw = spark.createDataFrame(rows, "source string, target string, external boolean, import_kinds int")
    want = [("a/y", "a/y", False, 0), ("a/y", "b/c", False, 3), ("a/y", "ext", True, 4)]
    for parts in (0, 3):
        assert sorted(map(tuple, graph.canonical(raw, parts=parts).collect())) == want
    text = plan(graph.canonical(raw, parts=3))
    assert "RepartitionByExpression" in text and "Filter" in text.split("Generate")[0]


def test_components_by_number_agree_with_those_by_path(spark):
    """Numbers without a file, ends outside the choice, repeated pairs and links within a folder make no dependency."""
    ones = spark.createDataFrame([(1, "a/x1.go"), (2, "a/x2.go"), (2, "c/x2.go"), (3, "b/x3.go"), (5, "root.go"), (6, "d/gone.go")], "a long, path string")
    others = spark.createDataFrame([(1, "b/y1.go"), (2, "e/y2.go"), (4, "a/y4.go"), (7, "f/gone.go")], "b long, path string")
    rows = [(1, 1, True, False), (1, 1, True, True), (2, 2, False, True), (2, 2, False, False), (3, 1, True, True), (1, 4, True, True), (5, 2, True, False), (6, 1, True, True)]
    rows += [(3, 7, True, True), (9, 1, True, True), (1, 9, True, True), (None, 1, True, True), (1, None, True, True), (3, 2, False, False)]
    pairs = spark.createDataFrame(rows, "a long, b long, there boolean, back boolean")
    left, right = {}, {}
    for side, found in ((ones, left), (others, right)):
        for number, path in side.collect():
            found.setdefault(number, []).append(path)
    made = [e for a, b, t, k in rows for p in left.get(a, []) for q in right.get(b, []) for e, on in (((p, q), t), ((q, p), k)) if on]
    paths = sorted({p for side in (left, right) for ps in side.values() for p in ps if "gone" not in p})
    files = spark.createDataFrame([(p, p.rpartition("/")[0] or ".") for p in paths], "path string, directory string")
    kinds = spark.createDataFrame([(p, p.endswith("1.go")) for p in paths], "path string, interface boolean")
    edges = create_edges(spark, [(p, p) for p in paths] + made)
    seen = lambda df: sorted(map(tuple, df.collect()))
    got = seen(M.components(edges, files, kinds, M.Links(pairs, ones, others)))
    assert got == seen(M.components(edges, files, kinds))
    want = {p.rpartition("/")[0] or ".": (set(), set()) for p in paths}
    for p, q in made:
        if p in paths and q in paths and p.rpartition("/")[0] != q.rpartition("/")[0]:
            want[p.rpartition("/")[0] or "."][0].add(q.rpartition("/")[0] or ".")
            want[q.rpartition("/")[0] or "."][1].add(p.rpartition("/")[0] or ".")
    assert {r[0]: (set(r[3]), set(r[4])) for r in got} == want and all(len(x) == len(set(x)) for r in got for x in r[3:])


def test_components_of_the_tables_meet_no_edge_by_path(spark):
    if os.path.isdir(SF):
        for name in ("components", "distance_metrics", "zone_of_pain", "zone_of_uselessness"):
            text = plan(queries.QUERIES[name](spark, SF))
            assert "(source#" not in text and "(target#" not in text, name


def test_components_follow_an_edge_once(spark):
    files = spark.createDataFrame([(f"{d}/{n}.go", d) for d in "ab" for n in "xy"], "path string, directory string")
    text = plan(M.components(trade(spark), files, files.selectExpr("path", "true as interface")))
    assert text.count("LeftSemi, (source#") == 1 == text.count("LeftSemi, (target#")


def test_empty_checks_of_metrics_compute_no_measure(spark, monkeypatch):
    """A rule on counts or folders is known not to be empty without the order lines."""
    if os.path.isdir(SF):
        looked = []
        monkeypatch.setattr(rules_on_metrics, "guard", lambda populations, options: looked.extend(populations))
        for name in ("custom_metric", "satisfaction", "threshold_below", "zone_of_pain", "zone_of_uselessness"):
            queries.QUERIES[name](spark, SF)
        assert len(looked) == 5
        for p in looked:
            assert "l_orderkey" not in plan(p.rows.select()), p


def test_members_are_counted_in_one_pass(spark, tmp_path):
    """Lines repeat suppliers and orders, lack a supplier, or have no order; a customer has no lines."""
    text = {
        "region": "0 r_regionkey, 'ASIA' r_name", "nation": "0 n_nationkey, 'CHINA' n_name, 0 n_regionkey",
        "customer": "explode(array(1L, 2L, 3L)) c_custkey, 0 c_nationkey, 'X' c_mktsegment", "supplier": "1L s_suppkey, 0 s_nationkey, 1D s_acctbal",
        "orders": "inline(array((10L, 1L, 'F'), (11L, 1L, 'F'), (12L, 2L, 'O'))) as (o_orderkey, o_custkey, o_orderstatus)",
        "lineitem": "inline(array((10L, 7L, 'A'), (10L, 7L, 'R'), (10L, 11L, 'A'), (11L, 7L, 'N'), (12L, null, 'A'), (99L, 7L, 'A'))) as (l_orderkey, l_suppkey, l_returnflag)",
    }
    for name, said in text.items():
        spark.sql(f"select {said}").write.parquet(f"{tmp_path}/{name}.parquet")
    counts = testdata.class_counts(spark, str(tmp_path))
    assert "Expand" not in plan(counts)
    assert sorted((r.name, r.method_count, r.field_count) for r in counts.collect()) == [("Customer_1", 2, 2), ("Customer_2", 1, 0), ("Customer_3", 0, 0), ("Supplier_1", 0, 0)]
