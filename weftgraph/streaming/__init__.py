"""Rules over edges that arrive as a stream: each micro-batch is merged into what came before and checked again.

The reference semantics are batch semantics, so a batch's violations are those of the whole graph so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators import graph


def recheck(edges: DataFrame, table: str, rule: Callable[[DataFrame], object], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query: rule(edges so far) gives something with check(), sink gets its violations and the batch's number.

    table is a folder of raw edges that grows by appends under the batch's number, so a batch that is replayed after a
    failure overwrites its own part; merging happens on reading.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.select("source", "target", "external", "import_kinds").write.mode("overwrite").parquet(f"{table}/batch={number}")
        whole = graph.canonical(df.sparkSession.read.parquet(table).drop("batch"))
        sink(rule(whole).check(), number)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
