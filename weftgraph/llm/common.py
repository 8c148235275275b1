"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.storage import remove_path, shared_dir, ship_package


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows in an Arrow batch of texts. Spark's default of ten thousand holds some hundred MB for each task where texts are long.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_ROWS rows for this session, unless it asks for smaller ones; and executors that can import this."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "0"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def map_texts(
    df: DataFrame, columns: dict[str, F.Column], schema: T.StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch]
) -> DataFrame:
    """Apply fn to Arrow batches of the named columns; nothing is kept between batches but caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    bound_batches(df.sparkSession)
    return df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def blocks_of(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to at most limit; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices that gather the slices [start, start+len) one after another."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lens), lens)


#: A key is hot if it holds more rows than this and than one in HOT_PARTS of all.
HOT_LEAST, HOT_PARTS = 4096, 1000


def hot_keys(counted: DataFrame, total: int) -> dict:
    """counted(key, rows) -> the parts into which each hot key's rows are dealt. Fewer than HOT_PARTS keys can be hot."""
    limit = max(HOT_LEAST, total // HOT_PARTS)
    found = counted.where(F.col(counted.columns[1]) > limit).collect()
    return {bytes(k) if isinstance(k, bytearray) else k: -(-n // limit) for k, n in found}


def salted_join(many: DataFrame, one: DataFrame, key: str, deal: str, hot: dict, how: str = "inner") -> DataFrame:
    """many.join(one, key), where the rows of hot keys are dealt into parts by the column deal and their rows of one copied to each.

    hot comes from hot_keys, so the copies are at most 2 * HOT_PARTS for each row that one has of a key. Columns: those of
    many, then one's but key.
    """
    if not hot:
        return many.join(one, key, how)
    spark = many.sparkSession
    at = [f.dataType for f in many.schema.fields if f.name == key][0]
    schema = T.StructType([T.StructField(key, at), T.StructField("__parts", T.IntegerType())])
    parts = F.broadcast(spark.createDataFrame(list(hot.items()), schema))  # fewer than HOT_PARTS rows
    part = F.coalesce(F.pmod(F.xxhash64(deal), F.col("__parts")), F.lit(0)).cast("int")
    left = many.join(parts, key, "left").withColumn("__part", part).select(*many.columns, "__part")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))
    right = one.join(parts, key, "left").withColumn("__part", every).select(*one.columns, "__part")
    return left.join(right, [key, "__part"], how).select(*many.columns, *[c for c in one.columns if c != key])
