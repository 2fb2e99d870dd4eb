"""An index of titles, and references of many queries resolved by it.

The index has one row for each folded title: how many catalog rows have it (2 stands for more than one) and the only row's id. It is a
written table that grows from new rows alone. References are folded once per distinct text, those whose key a Bloom filter of the index rules out
never travel, and hot titles, on either side, take no task of their own.

Defined results: a null or empty reference, or one of white space alone, matches nothing; a catalog row counts once for each of its different
folded titles, and a row that is there twice is no single match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import title_key
from quillon.operators import joins

NAMES = ("romaji", "english", "native")


def keys(catalog: DataFrame) -> DataFrame:
    """(key, matches, id): counts of the folded titles of catalog rows, up to two."""
    each = catalog.select("id", F.explode(F.array_distinct(F.array(*[title_key(F.col(f"title.{n}")) for n in NAMES]))).alias("key"))
    return _counted(each.where("key <> ''").select("key", F.lit(1).alias("matches"), "id"))


def _counted(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("key").agg(F.sum("matches").alias("n"), F.min("id").alias("id"))
    return found.select("key", F.least("n", F.lit(2)).cast("int").alias("matches"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def write(catalog: DataFrame, path: str) -> None:
    """A new index; fails if path exists."""
    keys(catalog).write.mode("errorifexists").parquet(path)


def update(spark: SparkSession, path: str, more: DataFrame, to: str) -> None:
    """The index at `path` with new catalog rows, as a new table: the rows that it was made of are not read."""
    old = spark.read.parquet(path)
    _counted(old.unionByName(keys(more))).write.mode("errorifexists").parquet(to)


def resolve(references: DataFrame, index: DataFrame, title: str = "title") -> DataFrame:
    """references with matches (0, 1, or 2 for more) and id (of the only match, else null)."""
    distinct = references.where(F.col(title).isNotNull()).select(F.col(title).alias("_title")).distinct()
    folded = distinct.withColumn("key", title_key(F.col("_title"))).where("key <> ''")
    found = joins.may_hold(folded, "key", joins.bloom(index, "key")).join(index, "key").select(F.col("_title").alias(title), "matches", "id")
    got = joins.looked_up(references, found, title, joins.hot_keys(references, title))
    return got.withColumn("matches", F.coalesce("matches", F.lit(0)))
