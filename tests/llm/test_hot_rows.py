"""Many equal rows without an id: whole results, and no task that has them all."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import encoders, exact_dedup, packing, simhash, substring_dedup

N, TEXT = 100_000, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.fixture(scope="module")
def hot(spark):
    """N equal rows without an id in 40 partitions, among others."""
    few = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.sha2((-F.col("id")).cast("string"), 256)).alias("text"))
    same = spark.range(N).select(F.lit(None).cast("long").alias("doc_id"), F.lit(TEXT).alias("text"))
    return same.unionAll(few).repartition(40).withColumn("n_chars", F.length("text"))


@pytest.fixture
def wide(spark):
    """Joins and exchanges as on large tables: no broadcast by size, no merged partitions."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(spark, run):
    """(what run() gives, the largest share of a stage's shuffled rows that one of its tasks read, of stages with N / 2 rows or more)."""
    store = spark.sparkContext._jsc.sc().statusStore()
    last = max((s.stageId() for s in _stages(store)), default=-1)
    got, worst = run(), 0.0
    for s in _stages(store):
        total = s.shuffleReadRecords()
        if s.stageId() > last and total >= N / 2:
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            read = [m.shuffleReadMetrics().recordsRead() for m in (tasks.apply(k).taskMetrics().get() for k in range(tasks.size()))]
            worst = max(worst, max(read) / total)
    return got, worst


def _stages(store):
    empty = store.getClass().getMethods()
    listed = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None) if empty else []
    return [listed.apply(k) for k in range(listed.size())]


def test_exact_copies(spark, hot, wide):
    for repeats, want in ((True, N + 2000), (False, 2001)):
        got, share = largest_share(spark, lambda r=repeats: exact_dedup.drop_copies(hot, repeats=r).groupBy("doc_id").count().agg(F.sum("count")).first()[0])
        assert got == want and 0 < share < 0.1


def test_near_copies(spark, hot, wide):
    got, share = largest_share(spark, lambda: simhash.drop_near_copies(hot).count())
    assert got >= N + 1000 and 0 < share < 0.1


def test_packing(spark, hot, wide):
    got, share = largest_share(spark, lambda: packing.pack(hot, encoders.path_of(encoders.BYTE_BPE), shard_pieces=5000).agg(F.sum("length"), F.count("*")).first())
    assert got[1] == N + 2000 and 0 < share < 0.1


def test_repeats(spark, hot, wide):
    got, share = largest_share(spark, lambda: substring_dedup.remove_repeats(hot).agg(F.sum("n_removed"), F.count("*")).first())
    assert got[1] == N + 2000 and got[0] == 0 and 0 < share < 0.1


def test_what_groups_send_is_in_proportion():
    """Groups and buckets are about equally many, so rows between them are groups squared."""
    mb = 1 << 20
    rows = [(-(-size // substring_dedup.grown(size, 10 * mb))) ** 2 for size in (1000 * mb, 4000 * mb, 9000 * mb)]
    assert rows[0] == 100**2 and 3.9 < rows[1] / rows[0] < 4.1 and 8.8 < rows[2] / rows[0] < 9.2
    assert substring_dedup.grown(10**15, 10 * mb) == 30 * mb and substring_dedup.grown(10**8, 10 * mb) == 10 * mb
