"""A ledger of used texts: which rows of a batch bring a text that nobody has used, in one go or batch by batch.

Each batch appends what it brings: its texts with their digests, and the bits of a Bloom filter in buckets. Of a new batch equal texts are
combined inside each task first; those that no bucket's filter may hold are new without a look at the ledger, and only the others meet it, by digest and
then by their whole text.

Defined results: rows without a text are left out; of equal texts the row with the least `order` brings it, a null order comes last.
Two batches must not be admitted at the same time: a batch reads the ledger that the one before has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import joins
from quillon.sources.scratch import written

TEXTS, BITS = "texts", "bits"


def _read(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    """All batches' parts of the ledger; an empty table before the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{what}")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{what}") if there else spark.createDataFrame([], schema)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """digest, text of all that was used."""
    return _read(spark, path, TEXTS, "digest binary, text string")


def _append(fresh: DataFrame, path: str) -> None:
    """The filter's bits go first: a batch whose texts were not written is then looked at once more, and nothing is taken for new twice."""
    batch = uuid.uuid4().hex
    joins.bloom(fresh, "digest").write.parquet(f"{path}/{BITS}/{batch}")
    fresh.select("digest", "text").write.parquet(f"{path}/{TEXTS}/{batch}")


def admit(rows: DataFrame, path: str, text: str, order: str) -> DataFrame:
    """The rows that bring a text of which neither the ledger nor an earlier row of theirs has any; their texts are in the ledger from now on."""
    spark, names = rows.sparkSession, rows.columns
    # the text is a key already, so the row that brings it travels without it
    rest = F.struct(*[F.col(c) for c in names if c != text], F.lit(True).alias("_there"))
    known = rows.where(F.col(text).isNotNull()).select(rest.alias("row"), F.struct(F.col(order).isNull(), F.col(order)).alias("at"), F.col(text).alias("text"))
    known = known.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    first = written(known.groupBy("digest", "text").agg(F.min_by("row", "at").alias("row")), "distinct_texts")
    bits = _read(spark, path, BITS, "bucket long, bits binary").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    maybe = joins.may_hold(first, "digest", bits)
    used = texts(spark, path).select(F.col("digest").alias("_digest"), F.col("text").alias("_text"))
    hits = written(maybe.join(used, (F.col("digest") == F.col("_digest")) & (F.col("text") == F.col("_text")), "left_semi").select("digest", "text"), "used_texts")
    fresh = written(first.join(hits, ["digest", "text"], "left_anti"), "fresh_texts")
    _append(fresh, path)
    return fresh.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])
