"""Places of sorted groups and digests of ordered ids, against plain versions."""

import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import audit
from quillon.operators import order_statistics as O

SHARES = {f"p{k}": k / 20 for k in range(1, 20)}


def places(values):
    s = sorted(values)
    return [s[math.ceil(p * len(s)) - 1] if s else None for p in SHARES.values()]


def test_shares_of_doubles(spark):
    """All different, of every magnitude and sign, in one large group and many small ones."""
    rng = random.Random(1)
    rows = [("big" if k % 3 else f"g{k % 97}" if k % 7 else None, rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300)) for k in range(20_000)]
    rows += [("zeros", x) for x in (0.0, -0.0, -1e-320, 5e-324)] + [("ends", x) for x in (math.inf, -math.inf, 1.0)] + [("none", None), ("one", 2.5)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "v"]).astype({"g": object}), "g string, v double")
    df = df.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = {r.g: list(r)[1:] for r in audit.nearest_rank(df, "v", SHARES, ["g"]).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g if isinstance(g, str) else None, []).append(v)
    assert got == {g: places(v) for g, v in groups.items()}


@pytest.mark.parametrize("kind", ["long", "int", "byte"])
def test_shares_of_whole_numbers(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.integers(-100, 100, 5000) if kind != "long" else np.concatenate([rng.integers(-(2**63), 2**63 - 1, 5000), [-(2**63), 2**63 - 1]])
    df = spark.createDataFrame(pd.DataFrame({"v": v})).select(F.col("v").cast(kind).alias("v"))
    got = audit.nearest_rank(df, "v", SHARES)
    assert list(got.first()) == places(v.tolist()) and got.schema["p1"].dataType == df.schema["v"].dataType
    assert list(audit.nearest_rank(df.where("false"), "v", SHARES).first()) == [None] * 19


def test_a_repeated_value_and_no_big_task(spark):
    """A third of all rows have one value: a task still reads only counts."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("long").alias("v"))
    values = [5 if k % 3 == 0 else k for k in range(30_000)]
    assert list(audit.nearest_rank(df, "v", SHARES).first()) == places(values)
    plan = audit.nearest_rank(df, "v", SHARES)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    with pytest.raises(TypeError):
        O.at_places(df.select(F.col("v").cast("string").alias("v")), [], "v", {"a": O.share(0.5)})


def test_length_summary(spark):
    rows = [("a", 1), ("a", 2), ("a", 10), ("a", None), (None, 4), (None, 5), ("empty", None)]
    got = {r.k: tuple(r)[1:] for r in audit.length_summary(spark.createDataFrame(rows, "k string, v long"), ["k"], "v").collect()}
    assert got == {"a": (4, 1, 2.0, 10, 10), None: (2, 4, 4.5, 5, 5), "empty": (1, None, None, None, None)}


def digest(ids):
    return hashlib.sha256(json.dumps(ids, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_ids_in_order(spark):
    rows = [("a", k * 7 % 101, f'i"{k}é') for k in range(100)] + [(None, 1, "x"), (None, 0, "y"), ("n", 1, None), ("n", 2, None)]
    df = spark.createDataFrame(rows, "g string, pos int, id string").repartition(3)
    want = {g: digest([i for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])]) for g in ("a", None, "n")}
    assert {r.g: r.sha256 for r in audit.ids_sha256(df, ["g"], "pos", "id").collect()} == want
    with pytest.raises(ValueError, match="twice"):
        audit.ids_sha256(df.unionAll(df), ["g"], "pos", "id")


def test_a_million_ids_in_bounded_memory(spark):
    """One group of 10^6 ids: the plan has no list of a group, and Python sees it batch by batch."""
    df = spark.range(1_000_000).select(F.lit("all").alias("g"), (-F.col("id")).alias("pos"), F.col("id"))
    found = audit.ids_sha256(df, ["g"], "pos", "id")
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert tuple(found.first()) == ("all", digest(list(range(999_999, -1, -1))), 1_000_000)


def test_places_of_a_group_travel_together(spark, monkeypatch):
    """Between digits there is one row for each value that places fall in, not one for each place."""
    tables, written = [], O.written
    monkeypatch.setattr(O, "written", lambda df, what: tables.append((what, written(df, what))) or tables[-1][1])
    df = spark.range(500).select((F.col("id") % 5).alias("g"), F.col("id").alias("v"))
    got = {r.g: [r[n] for n in SHARES] for r in audit.nearest_rank(df, "v", SHARES, ["g"]).collect()}
    assert got == {g: places(list(range(g, 500, 5))) for g in range(5)}
    first = [t for what, t in tables if what == "places"][0]
    assert first.count() == 5
