"""Token ids as ORC files in ascending doc_id order, and readers of them.

A row of a file: doc_id, part (the file's place in the order), first (ids before this row in its
file), n_tokens, ids array<int>. ORC run-length encodes the integers, splits the file into stripes
that are read in parallel, keeps an index entry for every `row_stride` rows and a Bloom filter on
doc_id, so that a search for few documents skips stripes and row groups from metadata alone.

Sorting is by range of doc_id, with bounds sampled by Spark, and tokens are made after the sort:
text is shuffled once and ids never. The offset of a document in the whole sequence is the ids of
all files before its own, one number for each file, and `first`.

Defined results: a null text is the empty text, of which only the end id is written. A null doc_id
sorts first; rows of one doc_id are in the order of the first `HEAD` characters of their texts, and beyond that of their places in the input, so that
many rows of one id, or without one, spread over files. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import encoders
from quillon.llm.common import by_batch, id_lists, pieces, texts_of

#: Characters of a text by which rows of one doc_id are ordered.
HEAD = 64
SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"


def _tokens(path: str, end_id: int):
    def run(batches):
        encode, part, first = encoders.word_ids(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in pieces(batch):
                ids, n = id_lists([encode(t) + end for t in texts_of(rows)])
                before = first + np.cumsum(n) - n
                first += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), ids],
                    names=["doc_id", "part", "first", "n_tokens", "ids"]
                )

    return run


def write_tokens(
    docs: DataFrame, to: str, tokenizer: str, end_id: int = 1, stripe_bytes: int = 64 << 20, row_stride: int = 1000, doc_id: str = "doc_id",
    text: str = "text"
) -> None:
    """Writes the ids of every whole text, each followed by end_id, below the folder `to`, which must not exist."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", F.substring("text", 1, HEAD), "place"]
    tokens = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("place").mapInArrow(_tokens(tokenizer, end_id), SCHEMA)
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes),
        "orc.row.index.stride": str(row_stride), "compression": "zstd"
    }
    tokens.write.options(**options).orc(to)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with doc_ids only theirs, found by min/max statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids of all files before each; a row for each file that was written."""
    totals = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def _sums(rows: pa.RecordBatch) -> dict:
    ids = rows.column("ids")
    at, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
    crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
    return {
        "doc_id": rows.column("doc_id"), "part": rows.column("part"), "first": rows.column("first"), "n_tokens": np.diff(at).astype(np.int64),
        "ids_crc32": crc
    }


def summary(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    read = read_tokens(spark, path).select("doc_id", "part", "first", "ids").mapInArrow(
        by_batch(_sums, schema, 4096), "doc_id long, part int, first long, n_tokens long, ids_crc32 long"
    )
    # one row a file
    return read.join(F.broadcast(file_starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
