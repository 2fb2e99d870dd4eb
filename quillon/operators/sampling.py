"""Weighted choices, by distribution as plain columns and by seed as a pandas UDF.

Where only the distribution counts, choices are joins and windows. Where a seed must give the same draws as
Python's generator does, a row's draws are made by random.Random(seed) in one pandas UDF; a choice with one
candidate takes no draw.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def choose(draws: DataFrame, table: DataFrame, context: str, option: str, weight: str, order: str, u: str = "u") -> DataFrame:
    """draws (context, u in [0, 1)) with the first option of their context whose cumulative share exceeds u.

    table has a few rows for each context; cumulative shares are bounds, so the choice is a join on context and range.
    """
    w = Window.partitionBy(context).orderBy(order)
    whole = F.sum(weight).over(Window.partitionBy(context))
    upto = F.sum(weight).over(w) / whole
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy(context))
    bounds = table.select(
        F.col(context).alias("_c"), F.col(option), F.when(last, F.lit(2.0)).otherwise(upto).alias("_high"), F.row_number().over(w).alias("_n")
    )
    bounds = bounds.withColumn("_low", F.coalesce(F.lag("_high").over(Window.partitionBy("_c").orderBy("_n")), F.lit(0.0))).drop("_n")
    return draws.join(
        F.broadcast(bounds), (F.col(context) == F.col("_c")) & (F.col(u) >= F.col("_low")) & (F.col(u) < F.col("_high"))
    ).drop("_c", "_low", "_high")


def value_weights(
    vocabulary: DataFrame, default: float, tiers: dict[str, float] | None = None, value_tiers: dict[str, str] | None = None,
    priority: dict[str, float] | None = None
) -> DataFrame:
    """vocabulary (value) with weight, a priority before a tier's weight before the default, and p, its share."""
    def lookup(table: dict | None) -> Column:
        items = [F.lit(x) for k, v in (table or {}).items() for x in (k, float(v))]
        return F.create_map(*items)[F.col("value")] if items else F.lit(None).cast("double")

    by_value = {v: tiers[t] for v, t in (value_tiers or {}).items()} if tiers else None
    weighted = vocabulary.withColumn("weight", F.coalesce(lookup(priority), lookup(by_value), F.lit(float(default))))
    total = weighted.agg(F.sum("weight").alias("_total"))
    return weighted.crossJoin(F.broadcast(total)).select("value", "weight", (F.col("weight") / F.col("_total")).alias("p"))  # one row


def pool_probabilities(pools: DataFrame, pool_weights: dict[str, float]) -> DataFrame:
    """pools (pool, value): P(value) = P(pool) / values of the pool."""
    w = F.create_map(*[F.lit(x) for k, v in pool_weights.items() for x in (k, float(v))])[F.col("pool")]
    rows = pools.withColumn("_w", w).withColumn("_n", F.count("*").over(Window.partitionBy("pool")))
    return rows.withColumn("p", F.col("_w") / F.lit(float(sum(pool_weights.values()))) / F.col("_n")).select("pool", "value", "p")


def upper_probabilities(base: DataFrame) -> DataFrame:
    """P(upper | lower) for every lower value: base (value, p) above it, normalised. A range join of small tables."""
    low = base.select(F.col("value").alias("lower"))
    rows = low.join(F.broadcast(base.select(F.col("value").alias("upper"), "p")), F.col("upper") >= F.col("lower"))
    return rows.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("lower"))).select("lower", "upper", "p")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to several tasks for each core: small rows that cost much to draw come in few splits of a file."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def weighted(rng: random.Random, options: list, weights: list[float]):
    """The first option whose cumulative share exceeds the draw, of which there is always one."""
    total = sum(weights)
    bounds = list(accumulate(w / total for w in weights))
    return options[min(bisect_right(bounds, rng.random()), len(options) - 1)]


def draw(rng: random.Random, options: list, weights: list[float]):
    """weighted(), but no draw for one option."""
    return options[0] if len(options) == 1 else weighted(rng, options, weights)


def draw_without(rng: random.Random, options: list, weights: list[float], k: int) -> list:
    """k options one after the other, what is left weighed anew each time; sorted."""
    left, out = list(zip(options, weights, strict=True)), []
    for _ in range(k):
        x = draw(rng, [o for o, _ in left], [w for _, w in left])
        out.append(x)
        left = [p for p in left if p[0] != x]
    return sorted(out)


def seeded_choices(rows: DataFrame, seed: str, options: list[str], weights: list[float], k: Column | int, to: str = "drawn") -> DataFrame:
    """rows with k options each, drawn without replacement by random.Random(seed)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(seeds: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([draw_without(random.Random(int(s)), options, weights, int(n)) for s, n in zip(seeds, ks, strict=True)])

    return spread(rows).withColumn(to, run(F.col(seed), F.lit(k) if isinstance(k, int) else k))


def shuffled_split(rows: DataFrame, order: str, seed: int, shares: tuple[int, int, int] = (80, 10, 10), range_rows: int = 100_000) -> DataFrame:
    """rows with split: the first 80 % by a seeded digest of `order` train, 10 % validation, the rest test.

    Global places come from counts per range of digests; the number of ranges follows the number of rows (65,536 at
    most), so no task sorts much more than `range_rows` rows.
    """
    n = rows.count()
    bits = min(16, max(4, (n // range_rows).bit_length()))
    keyed = rows.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string")).cast("binary"), 256))
    parts = keyed.withColumn("_b", F.shiftrightunsigned(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), 16 - bits))
    sizes = parts.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", order)) - 1
    placed = parts.join(F.broadcast(before), "_b").withColumn("_i", place)  # 65,536 rows at most
    train, val = n * shares[0] // 100, n * shares[1] // 100
    return placed.withColumn(
        "split", F.when(F.col("_i") < train, "train").when(F.col("_i") < train + val, "validation").otherwise("test")
    ).drop("_h", "_b", "_before", "_i")


def realised(spec: dict, templates: dict[str, str], separator: str = ", ", last: str = " and ") -> str:
    """The text of a query by templates: {field.operator: text with {values}, {min} or {max}}."""
    hard, out = spec["hard_constraints"], []

    def listed(values: list[str]) -> str:
        return values[0] if len(values) == 1 else separator.join(values[:-1]) + last + values[-1]

    for name, text in templates.items():
        field, _, op = name.partition(".")
        value = hard[field][op] if op and field in hard else hard.get(field, spec.get(field))
        if value not in (None, [], ""):
            out.append(text.format(values=listed(value) if isinstance(value, list) else value))
    return separator.join(out)
