"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import drop_scratch, scratch

#: Parts of a node's neighbours, 64 at most: no task takes more than one part of a node that many others have.
SALTS = 64


def _with_least(edges: DataFrame, own: Column | None = None) -> DataFrame:
    """edges (u, v) with m, the least of u's neighbours (and of u itself, if own), joined part by part."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    spread = least.select("u", F.explode(held).alias("salt"), (F.least("m", own) if own is not None else F.col("m")).alias("m"))
    return salted.join(spread, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, F.col("u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    joined = _with_least(edges)
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any direction -> (u, v) with v the least node of u's component, for every u that isn't it.

    Each round halves what is left at least in practice; its edges, at most as many as before, are written
    to the shared folder, so no round is computed twice, and the round before is removed. Only sums of the table come to the driver.
    """
    spark, path, before = edges.sparkSession, None, None
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        last, path = path, scratch(spark, "edges")
        now.write.parquet(path)
        if last:
            drop_scratch(spark, last)
        edges = spark.read.schema("u long, v long").parquet(path)
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sums == before or sums.n == 0:
            return edges
        now, before = _small_star(_large_star(edges)), sums
