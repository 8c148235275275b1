import os

import pytest

import __spark_entry__ as entry
from weftgraph import api, queries

SF = "/root/testdata/sf0.001"
SOME = (
    "canonical_edges", "select_files_path", "project_nodes", "depend_on_files_should", "external_should_not", "layer_policy",
    "diagram_adherence", "distance_metrics", "lcom4", "focus_2", "snapshot_edges", "circuits_regions",
    "go_graph", "go_file_metrics", "go_classes", "report_dot", "report_csv", "report_json",
)


def plain(rows, columns):
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(value(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


def test_registry():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(queries.QUERIES) > 60
    assert "project_files" in api.__all__


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _star_schema(spark, d, customers, suppliers, lines):
    """lines: (customer, supplier, return flag), each an order of its own."""
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "CHINA", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, 0, "MACHINERY") for k in customers], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "supplier": ([(k, 0, 1.0) for k in suppliers], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "part": ([(1, "Brand#11")], "p_partkey long, p_brand string"),
        "orders": ([(i, c, "F") for i, (c, _, _) in enumerate(lines)], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "lineitem": ([(i, s, 1, f) for i, (_, s, f) in enumerate(lines)], "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_no_cycles_files_searches_every_file(spark, tmp_path):
    customers, suppliers = [5, 12, 25, 138], [3, 17, 40]
    lines = [(c, s, "NRA"[(c + s) % 3]) for c in customers for s in suppliers] + [(12, 17, "R"), (25, 40, "R")]
    _star_schema(spark, str(tmp_path), customers, suppliers, lines)
    c, s = "demand/ASIA/CHINA/customer_{}.go".format, "supply/ASIA/CHINA/supplier_{}.go".format
    after = {}
    for a, b, flag in lines:
        after.setdefault(c(a), set()).add(s(b))
        if flag == "R":
            after.setdefault(s(b), set()).add(c(a))

    def walks(path):
        for to in after.get(path[-1], ()):
            if to == path[0]:
                yield ",".join(path)
            elif to > path[0] and to not in path:
                yield from walks([*path, to])

    want = sorted(w for x in after for w in walks([x]))
    assert 10 < len(want) < 1000
    assert sorted(r.members for r in queries.QUERIES["no_cycles_files"](spark, str(tmp_path)).collect()) == want
