"""A ledger of texts in one go and in batches, and files that only one writer makes."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, joins, ledger
from quillon.sources import scratch


def test_batches_give_what_one_go_gives(spark):
    rows = [(k, f"text {k % 37}", k % 3) for k in range(300)] + [(None, "text 5", 0), (None, "only here", 1), (1000, None, 1), (1001, "", 2)] + [(2000 + k, "hot", 2) for k in range(500)]
    df = spark.createDataFrame(rows, "pos long, text string, batch int").repartition(5)
    used = spark.createDataFrame([("text 3",), ("text 4",), ("nowhere",)], "text string")
    one, many = scratch.new_path(spark, "ledger"), scratch.new_path(spark, "ledger")
    for path in (one, many):
        assert ledger.admit(used.withColumn("pos", F.lit(0)), path, "text", "pos").count() == 3
    whole = df.withColumn("at", F.struct("batch", F.coalesce("pos", F.lit(10**9))))
    want = sorted((r.pos or -1, r.text) for r in audit.first_unused(whole, used, "text", "at").collect())
    assert sorted((r.pos or -1, r.text) for r in ledger.admit(whole, one, "text", "at").collect()) == want
    found = []
    for b in range(3):
        found += [(r.pos or -1, r.text) for r in ledger.admit(df.where(F.col("batch") == b), many, "text", "pos").collect()]
    assert sorted(found) == want
    assert ledger.admit(df, many, "text", "pos").count() == 0
    assert sorted(r.text for r in ledger.texts(spark, many).collect()) == sorted(r.text for r in ledger.texts(spark, one).collect())
    assert ledger.admit(df.where("false"), many, "text", "pos").count() == 0


def test_only_hits_of_the_filter_meet_the_ledger(spark):
    path = scratch.new_path(spark, "ledger")
    text = F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")
    ledger.admit(spark.range(5000).select("id", text), path, "text", "id")
    bits = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/bits")
    more = spark.range(4000, 20_000).select("id", text).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    assert 1000 <= joins.may_hold(more, "digest", bits).count() < 1100
    assert ledger.admit(spark.range(4000, 20_000).select("id", text), path, "text", "id").count() == 15_000


def test_a_text_is_written_once_in_each_table(spark, monkeypatch):
    """The row that brings a text has it back, but doesn't carry it beside the key."""
    tables, written = [], ledger.written
    monkeypatch.setattr(ledger, "written", lambda df, what: tables.append(df.dtypes) or written(df, what))
    got = ledger.admit(spark.createDataFrame([("a", 1), ("a", 0)], "text string, id long"), scratch.new_path(spark, "ledger"), "text", "id")
    assert got.columns == ["text", "id"] and [tuple(r) for r in got.collect()] == [("a", 0)]
    assert ledger.admit(spark.createDataFrame([("b",)], "text string"), scratch.new_path(spark, "ledger"), "text", "text").collect() == [("b",)]
    assert all(str(t).count("text") <= 1 for t in tables)
