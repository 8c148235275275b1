"""The base table: edges(source, target, external, import_kinds), one row for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import kinds
from weftgraph.functions.identifiers import normalize, normalized
from weftgraph.operators.projection import labelled

SCHEMA = "source string, target string, external boolean, import_kinds int"
COLUMNS = ("source", "target", "external", "import_kinds")
#: A table may carry this boolean column, true on self-edges. Where its parts know it as a constant, looking for nodes
#: leaves the other parts unread.
DECLARES = "declares"


def create_edges(spark: SparkSession, rows) -> DataFrame:
    """rows of (source, target[, external[, kinds]]), kinds a name, names or bits; canonical."""
    made = []
    for source, target, *rest in rows:
        external = bool(rest[0]) if rest else False
        said = rest[1] if len(rest) > 1 else 0
        made.append((source, target, external, said if isinstance(said, int) else kinds.mask(*([said] if isinstance(said, str) else said))))
    return canonical(spark.createDataFrame(made, SCHEMA))


def canonical(edges: DataFrame, normalize_ids: bool = True, parts: int = 0) -> DataFrame:
    """Identifiers normalised (an external target stays as written), empty ends dropped, parallel edges merged.

    A self-edge declares a node and carries neither kinds nor a mark. Partial aggregation merges before the shuffle; with
    parts, for edges of which few are parallel, all are dealt into so many and merged there, so a task's share stays small.
    """
    e = edges.select("source", "target", "external", "import_kinds")
    if normalize_ids:
        target = F.when(F.col("external"), F.trim("target")).otherwise(normalized(F.col("target")))
        e = labelled(e, clean_source=normalized(F.col("source")), clean_target=target)
        e = e.select(F.col("clean_source").alias("source"), F.col("clean_target").alias("target"), "external", "import_kinds")
    e = e.where((F.col("source") != "") & (F.col("target") != ""))
    own = F.col("source") == F.col("target")
    e = e.select(
        "source",
        "target",
        (F.coalesce("external", F.lit(False)) & ~own).alias("external"),
        F.when(own, F.lit(0)).otherwise(F.coalesce("import_kinds", F.lit(0))).alias("import_kinds"),
    )
    if parts:
        e = e.repartition(parts, "source", "target")
    return e.groupBy("source", "target").agg(
        F.bool_or("external").alias("external"), F.bit_or("import_kinds").cast("int").alias("import_kinds")
    )


def add(edges: DataFrame, more: DataFrame, parts: int = 0) -> DataFrame:
    return canonical(edges.select(*COLUMNS).unionByName(more.select(*COLUMNS)), parts=parts)


def nodes(edges: DataFrame) -> DataFrame:
    """Both ends of every edge, each once."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def self_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col(DECLARES) if DECLARES in edges.columns else F.col("source") == F.col("target"))


def own_nodes(edges: DataFrame) -> DataFrame:
    """What rules select from: every declared node."""
    return self_edges(edges).select(F.col("source").alias("node"))


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target")


def find(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The edge between two identifiers, a row or none. The target is looked for as written too, for external ends."""
    hit = (F.col("source") == normalize(source)) & F.col("target").isin(normalize(target), target.strip())
    return edges.where(hit).select(*COLUMNS).limit(1)
