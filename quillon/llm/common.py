"""Helpers that the corpus operators share: inputs, scratch tables, token caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import new_path, remove


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


#: The scratch tables of the calls that are under way here, innermost last; the first list has those of no call. Threads have lists of their own.
_lists: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_tables", default=())
_outside: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the folder that driver and executors share (sources.scratch.shared_folder)."""
    path = new_path(spark, what)
    (_lists.get() or (_outside,))[-1].append(path)
    return path


@contextmanager
def collected() -> Iterator[list[str]]:
    """The list of the scratch tables that are made inside the block by this thread; another call's are not in it."""
    mine: list[str] = []
    token = _lists.set((*_lists.get(), mine))
    try:
        yield mine
    finally:
        _lists.reset(token)
        (_lists.get() or (_outside,))[-1].extend(mine)


def given() -> tuple[str, ...]:
    """The paths of the scratch tables that are there, of the call under way or else of no call, in the order in which they were asked for."""
    return tuple((_lists.get() or (_outside,))[-1])


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Removes these scratch tables; drop_scratch(spark, *given()) removes all that no other call has made.

    Results of the operators are lazy and read such tables; so the caller removes them, once a result is written.
    """
    for path in paths:
        remove(spark, path)
        for held in (_outside, *_lists.get()):
            if path in held:
                held.remove(path)


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key that has more than one in so many rows is hot; there are at most so many hot keys.
HOT = 1 << 14


def looked_up(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the other columns of table, which has one row for each value of `key`, and in `size` how many rows have it.

    Hot keys, at most HOT by their definition, are broadcast, and their rows go on by position, so that no task gets
    all rows of one key; the rest is an ordinary join. `total` is the number of rows; keys are not null. table should be
    a written one: it is read twice. `size` itself isn't returned.
    """
    names = [c for c in table.columns if c not in (key, size)]
    is_hot = F.col(size) * HOT > total
    hot = table.where(is_hot).select(F.col(key).alias("_hot"), F.struct(*names).alias("_hot_found"))
    cold = table.where(~is_hot).select(F.col(key).alias("_cold"), F.struct(*names).alias("_cold_found"))
    anywhere = F.xxhash64(F.monotonically_increasing_id()).cast("string").cast(table.schema[key].dataType)
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(anywhere))
    found = found.join(cold, F.col("_key") == F.col("_cold"), "left").withColumn(
        "_found", F.when(F.col("_hot").isNotNull(), F.col("_hot_found")).otherwise(F.col("_cold_found"))
    )
    return found.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in names])


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def by_batch(f: Callable[[pa.RecordBatch], dict], schema: pa.Schema, rows: int = 256):
    """A function for mapInArrow that turns each few rows into the named columns of schema."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, rows):
                got = f(part)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((got[n], schema.field(n).type) for n in schema.names)],
                    schema=schema
                )

    return run


class Memo(dict):
    """A bounded dict that computes what it misses; when full it starts anew. Long keys aren't kept."""

    def __init__(self, f: Callable, limit: int = 400_000):
        super().__init__()
        self.f, self.limit = f, limit

    def __missing__(self, key):
        value = self.f(key)
        if len(key) < 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def id_lists(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Little-endian uint32 ids of each row as a list<int32> array, and the number of each."""
    n = np.fromiter((len(x) // 4 for x in blobs), np.int64, len(blobs))
    values = np.frombuffer(b"".join(blobs), np.int32)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())), n


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
