"""Tables written to the folder that driver and executors share, for iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and the session is a local one, as in tests, a temporary folder is made.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: MB of a Parquet input for one task that groups or joins its rows.
TASK_MB = 8
MOST_PARTS = 20_000


def dealt(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many parts as its source, a table that was read, is large: a task's memory does not grow with the data."""
    parts = parts_of(source)
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)  # else adaptive execution may join them


def parts_of(source: DataFrame) -> int:
    """How many parts a table's rows are dealt into; 0 if the session's shuffle partitions are enough."""
    size = int(str(source._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    parts = -(-size // (TASK_MB << 20))
    return 0 if parts <= int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")) else min(parts, MOST_PARTS)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Lets executors import this package, once for each context: it is sent to them as a zip by the driver.

    Nothing is sent if the package comes from an archive itself, which was shipped then already.
    """
    sc = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_weftgraph_shipped", False) or not os.path.isdir(here):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="weftgraph-code-"), "weftgraph.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, folders, names in os.walk(here):
            folders[:] = [d for d in folders if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._weftgraph_shipped = True


class Scratch:
    """Tables of one computation; drop() removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        remove_path(self.spark, f"{self.root}/{number}")
