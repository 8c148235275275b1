import io
import json
import math

import pytest

from weftgraph import report
from weftgraph.errors import EmptySnapshotError, TechnicalError, UserError
from weftgraph.operators import graph
from weftgraph.operators import metrics as M
from weftgraph.options import CheckOptions, LogOptions, Logger
from weftgraph.plans.files import project_files, udf_predicate
from weftgraph.plans.layers import project_layers
from weftgraph.plans.metrics import metrics, row_measure
from weftgraph.plans.slices import project_slices
from weftgraph.sinks import render
from weftgraph.sinks.metrics_page import MetricsExporter
from weftgraph.sources.diagram import Diagram, parse_diagram, render_plantuml

FILES = ["main.go", "internal/api/handler.go", "internal/api/router.go", "internal/db/conn.go", "internal/domain/user.go"]
EDGES = [
    ("main.go", "internal/api/handler.go"), ("internal/api/handler.go", "internal/db/conn.go"), ("internal/api/router.go", "internal/domain/user.go"),
    ("internal/db/conn.go", "internal/api/router.go"), ("internal/api/handler.go", "net/http", True, "plain"),
]
FREE = CheckOptions(allow_empty_tests=True)


@pytest.fixture(scope="module")
def edges(spark):
    return graph.create_edges(spark, [(f, f) for f in FILES] + EDGES).cache()


def said(rule, options=None):
    return sorted(report.sentence(v) for v in rule.check(options).collect())


def test_file_rules(edges):
    f = project_files(edges)
    assert said(f.in_folder("internal/**").should().have_name("h*")) == [f'{x}: should, filename matches "h*"; it does not' for x in sorted(FILES[2:])]
    assert said(f.should_not().be_in_folder("internal/db/**")) == ['internal/db/conn.go: should not, path without filename matches "internal/db/**"; it does']
    api = f.in_folder("internal/api/**")
    want = 'internal/api/handler.go: should not, depend on files, path without filename matches "internal/db/**"; it depends on internal/db/conn.go'
    assert said(api.should_not().depend_on_files().in_folder("internal/db/**")) == [want]
    want = 'internal/api/router.go: should, depend on files, path without filename matches "internal/db/**"; it depends on none of them'
    assert said(api.should().depend_on_files().in_folder("internal/db/**")) == [want]
    want = 'internal/api/handler.go: should not, depend on external modules, path matches "x/**" or path matches "net/**"; it depends on net/http'
    assert said(api.should_not().depend_on_external_modules().matching("x/**").matching("net/**")) == [want]
    assert said(api.except_name("handler.go").should().depend_on_external_modules())[0].startswith("internal/api/router.go: should, depend on external modules;")
    odd = graph.add(edges, graph.create_edges(edges.sparkSession, [("main.go", "sys\\\\io\\", True, "plain")]))
    assert [v["members"] for v in project_files(odd).should_not().depend_on_external_modules().matching("sys/io").check().collect()] == [["sys\\\\io\\"]]
    want = "internal/api/handler.go: should, have no cycles; it depends on itself through"
    assert said(f.should().have_no_cycles()) == []
    more = project_files(graph.add(edges, graph.create_edges(edges.sparkSession, [("internal/api/router.go", "internal/api/handler.go")])))
    assert said(more.should().have_no_cycles()) == [f"{want} internal/api/handler.go -> internal/db/conn.go -> internal/api/router.go -> internal/api/handler.go"]


def test_adherence(spark, edges):
    texts = spark.createDataFrame([(p, "x\n" * i) for i, p in enumerate(FILES)], "path string, source string")
    rule = project_files(edges).should_not().adhere_to(lambda f: f["source"] == "", "be empty", texts)
    assert said(rule) == ['main.go: should not, adhere to "be empty"; it does']
    rule = project_files(edges).should().adhere_to(udf_predicate(lambda r: len(r["source"]) > 2), "say more", texts)
    assert [v["subject"] for v in rule.check().orderBy("subject").collect()] == ["internal/api/handler.go", "main.go"]


def test_guard_errors_and_sentences(edges):
    f = project_files(edges)
    rule = f.in_folder("internal/nowhere/**").should().have_name("*")
    want = f'no files matched: path without filename matches "internal/nowhere/**"; {report.EMPTY_HINT}'
    assert said(rule) == [want] and said(rule, FREE) == []
    assert said(f.should_not().depend_on_files().in_folder("gone"))[0].startswith("no files to depend on matched")
    assert said(f.should_not().depend_on_external_modules().matching("gone")) == []
    bad = f.in_folder("[").with_name("").should().have_name("*")
    assert "rejected" in str(bad)
    with pytest.raises(UserError, match="in folder"):
        bad.check()
    for wrong in (f.except_("x").should().have_name("*"), f.should_not().have_no_cycles(), f.should().adhere_to(lambda x: x, " ")):
        with pytest.raises(UserError):
            wrong.check()
    assert str(f.in_folder("internal/**").should()) == 'project files, path without filename matches "internal/**", should'
    assert str(f.in_file("a*.go")) == 'project files, path matches "a*.go"' and f.in_file("a*.go").select_files().count() == 0


def test_layers(edges):
    p = project_layers(edges).layer("api").defined_by_folder("internal/api/**").layer("db").defined_by("internal/db/*.go")
    assert str(p.where_layer("api").may_not_depend_on_layers("db")) == (
        'project layers, layer "api" defined by path without filename matches "internal/api/**", layer "db" defined by path matches "internal/db/*.go", '
        'where layer "api", may not depend on layers "db"'
    )
    rule = p.where_layer("api").may_only_depend_on_layers().where_layer("api").may_not_depend_on_layers("db").where_layer("db").may_only_depend_on_layers("db")
    assert said(rule) == [
        'layer "api": may not depend on layers "db"; it depends on db through internal/api/handler.go -> internal/db/conn.go',
        'layer "db": may only depend on layers "db"; it depends on api through internal/db/conn.go -> internal/api/router.go',
    ]
    wide = p.layer("api").defined_by("main.go").layer("empty").defined_by_folder("gone")
    got = {r["layer"]: r["files"] for r in wide.select_layer_files().collect()}
    assert got == {"api": ["internal/api/handler.go", "internal/api/router.go", "main.go"], "db": ["internal/db/conn.go"], "empty": []}
    assert said(wide.where_layer("api").may_not_depend_on_layers("db"))[0].startswith('no files in layer "empty" matched')
    assert p.except_path("**/conn.go").select_layer_files().where("layer = 'db'").first()["files"] == []
    for wrong in (p.where_layer("x").may_only_depend_on_layers(), p.where_layer("api").may_not_depend_on_layers(), p.where_layer("api").may_only_depend_on_layers("x"), p):
        with pytest.raises(UserError):
            wrong.check()


def test_slices(edges, tmp_path):
    s = project_slices(edges).defined_by("internal/(**)/**")
    assert {r["slice"]: len(r["files"]) for r in s.select_slice_files().collect()} == {"api": 2, "db": 1, "domain": 1}
    want = 'slice "api": should not, contain dependency "db"; it depends on db through internal/api/handler.go -> internal/db/conn.go'
    assert said(s.should_not().contain_dependency("api", "db")) == [want]
    assert said(s.should().contain_dependency("db", "domain")) == ['slice "db": should, contain dependency "domain"; it does not depend on domain']
    assert said(s.should().contain_dependency("api", "db")) == []
    assert said(s.should().contain_dependency("api", "gone"))[0].startswith('no files in slice "gone" matched')
    diagram = "@startuml\n' c\n/' x\n'/\ncomponent api\n[db]\n[api] --> domain : uses\napi -> db\n@enduml"
    rule = s.should().adhere_to_diagram(diagram)
    assert said(rule) == ['slice "db": should, adhere to diagram; it depends on api, which the diagram does not draw through internal/db/conn.go -> internal/api/router.go']
    short = s.should().adhere_to_diagram("[api] -> [absent]\n")
    assert len(said(short)) == 3 and len(said(short.ignoring_absent_components())) == 2 and len(said(short.ignoring_orphan_slices())) == 3
    assert s.to_plantuml() == (
        "@startuml\n' 3 components, 3 dependencies\ncomponent [api]\ncomponent [db]\ncomponent [domain]\n[api] --> [db]\n[api] --> [domain]\n[db] --> [api]\n@enduml\n"
    )
    s.export_as_plantuml(str(tmp_path / "deep" / "a.puml"))
    assert said(s.should().adhere_to_diagram_in_file(str(tmp_path / "deep" / "a.puml"))) == []
    with pytest.raises(TechnicalError):
        s.should().adhere_to_diagram_in_file("/absent").check()
    with pytest.raises(EmptySnapshotError):
        project_slices(edges).defined_by("none/(*)/**").to_plantuml()
    none = project_slices(edges)
    for wrong in (none.should().contain_dependency("a", "b"), s.defined_by_file_suffix().should().contain_dependency("a", "b"), s.should().contain_dependency("a", "a"),
                  s.should().contain_dependency("", "a"), s.should().adhere_to_diagram("nonsense here")):
        with pytest.raises(UserError):
            wrong.check()
    named = graph.create_edges(edges.sparkSession, [(x, x) for x in ("a/user_service.go", "plain.go", "b/order_.go")])
    assert sorted(r["slice"] for r in project_slices(named).defined_by_file_suffix().select_slice_files().collect()) == ["plain", "service"]


def test_diagrams():
    d = parse_diagram("COMPONENT [a b]\n[a b] ---> [c]:x > y\nc --> a\nc --> c\n[c] -> [a b]")
    assert d == Diagram(("a b", "c", "a"), (("a b", "c"), ("c", "a"), ("c", "a b")))
    assert parse_diagram(render_plantuml(["x[1]", "y"], [("x[1]", "y")])) == Diagram(("x(1)", "y"), (("x(1)", "y"),))
    for bad in ("", "@startuml\n@enduml", "[a] <-- [b]", "[a] > [b]", "a b --> c", "[a", "actor x", "[a] --> [b] <|-- [c]"):
        with pytest.raises(UserError):
            parse_diagram(bad)


@pytest.fixture(scope="module")
def tables(spark, edges):
    files = spark.createDataFrame([(p, p.rpartition("/")[0] or ".", 10 * i, i, 1, 0) for i, p in enumerate(FILES)],
                                  "path string, directory string, lines_of_code int, statement_count int, import_count int, function_count int")
    method = "array<struct<name:string,accessed_fields:array<string>>>"
    f = "array<struct<name:string,accessed_by:array<string>>>"
    rows = [
        ("internal/api/handler.go", "internal/api", "Handler", "internal/api.Handler", False, [("r", ["Read", "Copy"]), ("w", ["Copy", "Write"])], [("Read", ["r"]), ("Copy", ["r", "w"]), ("Write", ["w"])]),
        ("internal/api/router.go", "internal/api", "Router", "internal/api.Router", True, [], []),
        ("internal/db/conn.go", "internal/db", "Conn", "internal/db.Conn", False, [("a", ["A"]), ("b", ["B"])], [("A", ["a"]), ("B", ["b"])]),
    ]
    classes = spark.createDataFrame(rows, f"path string, directory string, name string, identifier string, interface boolean, fields {f}, methods {method}")
    return files, classes.selectExpr("*", "size(fields) as field_count", "size(methods) as method_count")


def test_cohesion(edges, tables):
    got = {(r["subject"], r["metric"]): r["value"] for r in metrics(edges, *tables).lcom().measure().collect()}
    names = ("LCOM96a", "LCOM96b", "LCOM1", "LCOM2", "LCOM3", "LCOM4", "LCOM5", "LCOM*")
    assert [got["internal/db.Conn", n] for n in names] == [1, 0.5, 1, 0.5, 1, 2, 1, 1]
    assert [round(got["internal/api.Handler", n], 6) for n in names] == [0.5, 0.333333, 0, 0.333333, 0.5, 1, 0.666667, 0.333333]
    assert {got["internal/api.Router", n] for n in names} == {0}


def test_metrics(edges, tables, tmp_path):
    m = metrics(edges, *tables)
    c = {r["label"]: r for r in m.subjects().components.collect()}
    assert (c["internal/api"]["classes"], c["internal/api"]["interfaces"], c["internal/api"]["depends_on"], c["internal/api"]["depended_on_by"]) == (
        2, 1, ["internal/db", "internal/domain"], [".", "internal/db"])
    d = {(r["subject"], r["metric"]): r["value"] for r in m.distance().measure().collect()}
    assert d["internal/api", "abstractness"] == 0.5 and d["internal/api", "instability"] == 0.5 and d["internal/api", "normalized distance"] == 0
    assert d["internal/api", "coupling factor"] == 4 / 6 and math.isclose(d["internal/domain", "distance from the main sequence"], 1 / math.sqrt(2))
    assert said(m.distance().should_not_be_in_zone_of_pain()) == [
        'component "internal/domain": should not, be in zone of pain; it is, at abstractness 0 and instability 0']
    rule = m.in_folder("internal/**").count().lines_of_code().should_be_below_or_equal(20)
    assert str(rule) == 'metrics, path without filename matches "internal/**", count, lines of code, should be below or equal 20'
    assert said(rule) == ["internal/db/conn.go: should, be below or equal 20; it is not, at lines of code 30", "internal/domain/user.go: should, be below or equal 20; it is not, at lines of code 40"]
    assert said(m.for_classes_matching("H*").count().method_count().should_be(3)) == []
    assert {r["path"] for r in m.for_classes_matching("Con?").subjects().files.collect()} == {"internal/db/conn.go"}
    assert said(m.for_classes_matching("Nope").count().method_count().should_be(3))[0].startswith("no measurements matched")
    weight = m.custom_metric("weight", "how heavy", row_measure(lambda c: float(2 * c["method_count"] + c["field_count"])))
    assert {r["value"] for r in weight.measure().collect()} == {8.0, 0.0, 6.0}
    nan = m.custom_metric("nan", "never", lambda c: M.F.lit(float("nan")))
    assert len(said(nan.should_be_above(-math.inf))) == 3
    rule = m.count().field_count().should_satisfy(lambda v, c: (v["value"] > 0) | c["interface"], "have fields")
    assert said(rule) == []
    assert len(said(m.count().field_count().should_not_satisfy(row_measure(lambda v, c: v["value"] > 0 and not c["interface"]), "be empty"))) == 2
    for wrong in (m.count().imports().should_be(math.nan), m.count().imports().should_satisfy(lambda v, c: v["value"] > 0, ""), m.custom_metric("", "x", lambda c: 1).should_be(1),
                  m.with_name("*").except_class("X").count().imports().should_be(1)):
        with pytest.raises(UserError):
            wrong.check()
    page = m.count().to_html()
    assert "<h2>lines of code</h2>" in page and '<p class="spread">5 measurements, min 0, max 40, average 20</p>' in page
    m.lcom().export_as_html(str(tmp_path / "lcom.html"))
    assert (tmp_path / "lcom.html").read_text().startswith("<!DOCTYPE html>")
    with pytest.raises(EmptySnapshotError):
        m.in_folder("gone").count().to_html()


def test_metrics_page():
    data = {"statements": [("statements", "ebb.go", 12.0), ("statements", "x&y<z>.go", 2.0)], "functions": [("functions", f"f{k}.go", k / 7) for k in range(3)]}
    page = MetricsExporter().to_html(data)
    for want in ('<p class="summary">5 measurements in 2 groups</p>', "average 7</p>", "average 0.14285714285714285</p>", '<td class="subject">x&amp;y&lt;z&gt;.go</td><td>statements</td><td class="value">2</td>'):
        assert want in page
    assert page.index("<h2>functions</h2>") < page.index("<h2>statements</h2>")


def test_renderers():
    d = render.Drawn("who lends to whom", [("bank", False), ("mill", False), ("sea/port", True), ("well", False)],
                     [("bank", "mill", 1, False, 0), ("mill", "bank", 12, False, 9), ("mill", "sea/port", 3, True, 2)])
    lines = lambda f: f(d).split("\n")
    counts = "4 nodes, 3 edges, 16 dependencies, 1 external node, 1 external edge"
    dot = lines(render.dot)
    assert dot[0] == 'digraph "who lends to whom" {' and dot[-2:] == ["}", ""]
    assert f'\tlabel="who lends to whom\\n{counts}";' in dot and '\t"well" [label="well"];' in dot
    assert dot[-6:-2] == ['\t"well" [label="well"];', '\t"bank" -> "mill";', '\t"mill" -> "bank" [label="12"];', '\t"mill" -> "sea/port" [label="3", style=dashed];']
    assert '\t"sea/port" [label="sea/port", style=dashed];' in dot
    mermaid = lines(render.mermaid)
    assert mermaid[1:3] == [f"%% {counts}", "flowchart LR"] and mermaid[5] == '\tn2(["sea/port"])'
    assert mermaid[-4:] == ["\tn0 --> n1", "\tn1 -->|12| n0", "\tn1 -->|3| n2", ""]
    d2 = lines(render.d2)
    assert d2[2] == "direction: right" and d2[5] == 'n2: {label: "sea/port"; style.stroke-dash: 3}' and d2[-4:] == ["n0 -> n1", 'n1 -> n0: "12"', 'n1 -> n2: "3"', ""]
    csv = lines(render.csv)
    assert csv[0] == "kind,source,target,dependencies,external,import kinds" and csv[3] == "node,sea/port,,,true,"
    assert csv[5:] == ["edge,bank,mill,1,false,", 'edge,mill,bank,12,false,"plain, dot"', "edge,mill,sea/port,3,true,aliased", ""]
    back = json.loads(render.json(d))
    assert back["summary"] == {"nodes": 4, "edges": 3, "dependencies": 16, "externalNodes": 1, "externalEdges": 1} and back["edges"][1]["importKinds"] == ["plain", "dot"]
    odd = render.Drawn("", [('5" nail', False), ("c:\\tmp", False), ("1,2<3>", False), ("up\r\ndown\rend", False)], [])
    assert '"5\\" nail" [label="5\\" nail"];' in render.dot(odd) and '"c:\\\\tmp"' in render.dot(odd)
    assert 'node,"5"" nail",,,false,' in render.csv(odd) and "1,2&lt;3&gt;" in render.page(odd) and "\\u003c" in render.json(odd)
    # a carriage return goes, a line feed is said in the format's own way
    assert '"up\\ndownend"' in render.dot(odd) and '["up downend"]' in render.mermaid(odd) and 'label: "up downend"' in render.d2(odd)


def test_results_and_asserts(edges):
    rule = project_files(edges).should().have_name("main.go")
    got = report.result(rule.check(), report.MessageOptions(max_violations=1))
    lines = got.message.split("\n")
    assert not got.passed and lines[0] == "4 violations:" and lines[1].startswith("  1. ") and lines[2] == "  ... and 3 violations not listed, because MaxViolations is 1"
    assert report.result(project_files(edges).should().have_name("*").check()) == report.Result(True, "no violations")
    with pytest.raises(AssertionError, match="4 violations"):
        report.assert_passes(rule)
    with pytest.raises(AssertionError):
        report.assert_passes(None)
    with pytest.raises(AssertionError):
        report.assert_all_pass({})
    with pytest.raises(AssertionError, match="b: "):
        report.assert_all_pass({"a": project_files(edges).should().have_name("*"), "b": rule})
    assert report.COLOURS.paint("passed", "x") == "\x1b[32mx\x1b[0m"


def test_figures():
    for x, want in ((0.25, "0.25"), (1.0, "1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-5, "1e-05"), (0.0001, "0.0001"), (-2.5e-7, "-2.5e-07"), (0.0, "0"),
                    (math.inf, "+Inf"), (math.nan, "NaN"), (123456.789, "123456.789"), (5.333333333333333, "5.333333333333333")):
        assert report.figure(x) == want


def test_logs(edges, tmp_path):
    out = io.StringIO()
    rule = project_files(edges).should().have_name("main.go")
    rule.check(CheckOptions(log=LogOptions(writer=out, level="debug")))
    lines = out.getvalue().splitlines()
    assert lines[0] == f"INFO  start check: {rule}" and lines[-1] == f"INFO  end check: {rule}: 4 violations"
    assert lines[1] == "DEBUG progress: selected files: 5" and lines[2].startswith("WARN  violation: file-naming: ") and len(lines) == 7
    project_files(edges).should().have_name("*").check(CheckOptions(log=LogOptions(folder=str(tmp_path / "logs"))))
    assert [p.suffix for p in (tmp_path / "logs").iterdir()] == [".log"]
    with pytest.raises(TechnicalError):
        Logger(LogOptions(file="/proc/none/x.log"))
    with pytest.raises(UserError):
        project_files(edges).in_folder("[").should().have_name("*").check(CheckOptions(log=LogOptions(writer=out)))
    assert "failed" in out.getvalue()
