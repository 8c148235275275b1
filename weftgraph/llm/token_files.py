"""Token ids as Parquet files: one list column, in document order, with small sortable metadata beside it.

Ids are dictionary encoded (a vocabulary fits one dictionary page, so ids cost their bit width) and fall
back to delta encoding; ordered integers are delta encoded. Row groups and pages have stated sizes and
every column has a page index, so a reader takes single documents, id ranges or metadata alone without
reading the rest. Files follow each other in document order and hold each document's start within
its file; the starts of files come from the metadata columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.bpe import byte_alphabet
from weftgraph.llm.common import bound_batches
from weftgraph.llm.pretokens import BatchEncoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


@lru_cache(2)
def library_encoder(path: str) -> BatchEncoder:
    """The tokenizers library encodes each distinct pre-token; batches are put together from those."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = (tok := Tokenizer.from_file(path)).model
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    stand_in = {b: ch for ch, b in byte_alphabet().items()}

    def encode_word(word: str) -> list[int]:
        return [t.id for t in model.tokenize(word.encode("utf-8").decode("latin-1").translate(stand_in))]

    return BatchEncoder(encode_word, *next(iter(special.items())))


def write_token_files(
    df: DataFrame,
    tokenizer: str,
    out: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode each text, append end_id, and write id, file_no, file_start, n_tokens, ids in ascending id order.

    A null or empty text has the end id alone. Null ids come first; rows with the same id are ordered by
    text. An empty table writes files without rows. Other columns are left out.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("file_no", T.IntegerType()),
            T.StructField("file_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer).encode
        number, before, step = TaskContext.get().partitionId(), 0, 512
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                flat, n = encode([t or "" for t in batch.column(1).to_pylist()])
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end_id)
                offsets = np.concatenate([[0], np.cumsum(n + 1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(n), number, np.int32)),
                        pa.array(before + offsets[:-1]),
                        pa.array(n + 1),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    ],
                    schema.names,
                )
                before += int(offsets[-1])

    bound_batches(df.sparkSession)
    (
        df.select(F.col(id_col), F.col(text_col).cast("string").alias("__weft_text"))
        .repartitionByRange(id_col)
        .sortWithinPartitions(id_col, "__weft_text")
        .mapInArrow(run, schema)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(out)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All columns but the ids, and start: the number of ids before the document. The ids are not read."""
    meta = spark.read.parquet(path).drop("ids")
    per_file = meta.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    order = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    files = per_file.select("file_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__weft_before"))
    # a row for each file: at most the number of shuffle partitions
    return meta.join(F.broadcast(files), "file_no").withColumn("start", F.col("__weft_before") + F.col("file_start")).drop("__weft_before")


def read_ids(spark: SparkSession, path: str, low=None, high=None, id_col: str = "doc_id") -> DataFrame:
    """id and ids of the documents with low <= id <= high; row groups and pages outside are skipped."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col(id_col) >= low)
    if high is not None:
        df = df.where(F.col(id_col) <= high)
    return df.select(id_col, "ids")


def token_digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start, n_tokens, and the CRC-32 of its ids as little-endian 32-bit integers."""
    found = spark.read.parquet(path)
    schema = T.StructType(
        [
            found.schema[id_col],
            T.StructField("file_no", T.IntegerType()),
            T.StructField("file_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                schema.names,
            )

    digest = found.select(id_col, "file_no", "file_start", "ids").mapInArrow(run, schema)
    files = read_metadata(spark, path).where("file_start = 0").select("file_no", F.col("start").alias("__weft_before"))
    files = files.groupBy("file_no").agg(F.min("__weft_before").alias("__weft_before"))
    return digest.join(F.broadcast(files), "file_no").select(
        id_col, (F.col("__weft_before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )
