"""The driver's test tables as a catalog: an item is an order, its genres part types, its tags brands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(c: str) -> Column:
    """A number of two places as a whole one: sums of these don't depend on the order of rows."""
    return F.round(F.col(c) * 100).cast("long")


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order with lines; lines are shuffled once, by order, with the part's type and brand already attached.

    They are dealt before they are grouped: lists of one order's lines made before that would be lists of one line, sorted and packed for nothing.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    line = F.struct("p_type", F.col("p_brand").alias("name"), F.least(F.lit(100), (2 * F.col("l_quantity")).cast("int")).alias("rank"))
    grouped = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.count("*").cast("int").alias("episodes"), F.collect_list(line).alias("_lines"),
        F.floor(F.sum(_hundredths("l_extendedprice")) / 100).alias("popularity"), F.floor(10 * F.sum(_hundredths("l_discount")) / F.count("l_discount")).cast("int").alias("averageScore"),
    )
    best = F.transform(
        F.array_sort(F.array_distinct(F.transform("_lines", lambda t: t["name"]))),
        lambda n: F.struct(n.alias("name"), F.array_max(F.transform(F.filter("_lines", lambda t: t["name"] == n), lambda t: t["rank"])).alias("rank")),
    )
    types = F.array_sort(F.array_compact(F.array_distinct(F.transform("_lines", lambda t: t["p_type"]))))
    return grouped.withColumns({"genres": types, "tags": best}).drop("_lines")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customers' names as (ambiguous) titles; unknown facts stay null, lists are empty."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = orders.join(
        line_facts(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    title = F.struct(
        F.col("c_name").alias("romaji"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("english"),
        F.lit(None).cast("string").alias("native")
    )
    return rows.select(
        F.col("o_orderkey").alias("id"), title.alias("title"), F.col("o_orderpriority").alias("format"), F.col("o_orderstatus").alias("status"), "year", "episodes",
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), F.coalesce(
            "tags", F.array().cast("array<struct<name:string,rank:int>>")
        ).alias("tags"),
        "popularity", "averageScore", (F.col("o_orderstatus") == "P").alias("isAdult"),
    )


#: The same catalog in DuckDB, as common table expressions.
CATALOG_SQL = """
ll AS (SELECT l_orderkey AS k, p_type, p_brand, CAST(least(100, 2 * l_quantity) AS INT) AS rank, l_extendedprice AS price, l_discount AS disc FROM lineitem JOIN part ON l_partkey = p_partkey),
facts AS (SELECT k, CAST(count(*) AS INT) AS episodes, list_sort(list(DISTINCT p_type)) AS genres, CAST(sum(CAST(round(price * 100) AS BIGINT)) // 100 AS BIGINT) AS popularity, CAST(10 * sum(CAST(round(disc * 100) AS BIGINT)) // count(disc) AS INT) AS averageScore FROM ll GROUP BY k),
brands AS (SELECT k, p_brand AS name, max(rank) AS rank FROM ll GROUP BY k, p_brand),
tagged AS (SELECT k, list(name ORDER BY name) FILTER (rank >= 50) AS rt, list(name ORDER BY name) FILTER (rank >= 1) AS xt FROM brands GROUP BY k),
cat AS (SELECT o_orderkey AS id, c_name AS romaji, 'Order#' || o_orderkey AS english, o_orderpriority AS format, o_orderstatus AS status, CAST(year(o_orderdate) AS INT) AS year,
        episodes, coalesce(genres, []) AS genres, coalesce(rt, []) AS rt, coalesce(xt, []) AS xt, popularity, averageScore, o_orderstatus = 'P' AS isAdult
        FROM orders LEFT JOIN facts f ON f.k = o_orderkey LEFT JOIN tagged t ON t.k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)
"""
