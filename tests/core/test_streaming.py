from weftgraph.operators import graph
from weftgraph.plans.files import project_files
from weftgraph.streaming import recheck


def test_each_batch_checks_the_graph_so_far(spark, tmp_path):
    src = str(tmp_path / "in")
    first = [("a.go", "a.go", False, 0), ("b.go", "b.go", False, 0), ("a.go", "b.go", False, 1)]
    spark.createDataFrame(first, graph.SCHEMA).coalesce(1).write.parquet(src)
    seen = []
    rule = lambda e: project_files(e).should().have_no_cycles()

    def run():
        stream = spark.readStream.schema(graph.SCHEMA).parquet(src)
        recheck(stream, str(tmp_path / "table"), rule, lambda v, n: seen.append((n, v.count())), str(tmp_path / "ckpt")).awaitTermination(120)

    run()
    spark.createDataFrame([("b.go", "a.go", False, 1)], graph.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    assert seen == [(0, 0), (1, 1)]
