"""Token ids of texts, made in bounded parts."""

from pyspark.sql import functions as F

from quillon.operators import sft


def test_ids_leave_in_parts(spark, monkeypatch):
    """A batch of many rows is not held as lists: its ids leave in parts; none is lost, and null and empty texts have none."""
    rows = spark.range(0, 3000, 1, 1).withColumn("t", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 7 == 1, "").otherwise(F.repeat(F.lit("ab"), 200)))
    got = sft.tokenised(rows, "t", "ids", lambda t: list(t.encode())).orderBy("id").collect()
    assert len(got) == 3000 and all(r.ids == list((r.t or "").encode()) for r in got)
    assert sum(len(r.ids) for r in got) > 2 * sft.PART
