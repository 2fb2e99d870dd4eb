"""The values at given places of sorted groups, by histograms that are refined digit by digit; no task holds a group's values.

Values become whole numbers in the same order, counted once for each (group, value). Counts of their leading digits of `DIGIT` bits show
which first digit a wanted place falls in and what place it is among its values, then the next digit, until the value is
known: a task sorts the counts of one digit at a time, at most 2 ** DIGIT, once for all places that fall in them. A group of a third of all rows is thus spread by its values, and a value that
a third of all rows have is combined inside each task first.

Defined results: nulls are no values; NaN comes after all others and -0.0 counts as 0.0. A group without values has nulls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.scratch import written

#: Bits of a digit.
DIGIT = 16


@F.pandas_udf(T.LongType())
def _order_of(values: pd.Series) -> pd.Series:
    """A whole number for each double, in the same order."""
    bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.pandas_udf(T.DoubleType())
def _value_of(orders: pd.Series) -> pd.Series:
    bits = orders.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group: by, and for each name the value at its place (a function of the number of values; 1 is the least)."""
    kind = rows.schema[value].dataType
    real = isinstance(kind, (T.DoubleType, T.FloatType))
    if not real and not isinstance(kind, T.IntegralType):
        raise TypeError(f"{value} is no number of a type that has an order here: {kind.simpleString()}")
    # null groups are groups, so they need keys that joins match
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    keyed = rows.where(F.col(value).isNotNull()).select(group.alias("g"), (_order_of(F.col(value).cast("double")) if real else F.col(value).cast("long")).alias("v"))
    counts = written(keyed.groupBy("g", "v").agg(F.count("*").alias("n")), "value_counts")
    sizes = counts.groupBy("g").agg(F.sum("n").alias("n"))
    # the places of a group travel as one list, so that its counts are joined and sorted once whatever the number of places
    listed = F.array(*[F.struct(F.lit(k).alias("k"), place(F.col("n")).cast("long").alias("place")) for k, place in enumerate(places.values())])
    wanted = sizes.select("g", listed.alias("ws"), F.lit(None).cast("long").alias("high"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digits = counts.groupBy("g", F.shiftright("v", shift).alias("low")).agg(F.sum("n").alias("n"))
        digits = digits.select(F.col("g").alias("_g"), "low", "n", (F.lit(None).cast("long") if shift == 64 - DIGIT else F.shiftright("low", DIGIT)).alias("_high"))
        within = wanted.join(digits, F.col("g").eqNullSafe(F.col("_g")) & F.col("high").eqNullSafe(F.col("_high")))
        upto = F.sum("n").over(Window.partitionBy("g", "high").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        before = F.col("upto") - F.col("n")
        found = within.withColumn("upto", upto).withColumn("ws", F.filter("ws", lambda w: (w["place"] <= F.col("upto")) & (w["place"] > before))).where(F.size("ws") > 0)
        left = F.transform("ws", lambda w: F.struct(w["k"].alias("k"), (w["place"] - before).alias("place")))
        wanted = found.select("g", left.alias("ws"), F.col("low").alias("high"))
        if shift:
            wanted = written(wanted, "places")
    got = (_value_of(F.col("high")) if real else F.col("high")).cast(kind)
    named = wanted.withColumn("value", got)
    columns = [F.max(F.when(F.exists("ws", lambda w: w["k"] == k), F.col("value"))).alias(name) for k, name in enumerate(places)]
    return named.groupBy("g").agg(*columns).select("g.*", *places) if by else named.agg(*columns)


def share(p: float) -> Callable[[Column], Column]:
    """The nearest-rank place of a share: ceil(p * n)."""
    if not 0 < p <= 1:
        raise ValueError(f"no share above 0 and up to 1: {p}")
    return lambda n: F.ceil(F.lit(p) * n)
