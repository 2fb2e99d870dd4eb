"""Folding without Python, title indexes and lookups of many references."""

import random
import sys

import pandas as pd
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import joins, search, titles
from quillon.sources import scratch
from quillon.sources.schemas import CATALOG


def catalog_of(spark, rows):
    """rows of (id, romaji, english, native)."""
    named = spark.createDataFrame(rows, "id long, romaji string, english string, native string")
    title = F.struct("romaji", "english", "native").alias("title")
    return named.select(*[title if f.startswith("title") else F.col("id") if f.startswith("id ") else F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split(" ")[0]) for f in CATALOG.split(", ")])


def test_folding_of_all_code_points(spark):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [f" A{chr(c)}b{chr(c)} " for c in points] + [chr(c) for c in points] + ["ΑΣ ΑΣ", "é", "각", "각", "ﬁ Ⅳ ß İ", "", "  ", "\x1c\x85 x \t"]
    rng = random.Random(4)
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x300, 0x370), rng.randrange(0x3000, 0x3100), rng.randrange(0xAC00, 0xD7A4)])) for _ in range(6)) for _ in range(20_000)]
    df = spark.createDataFrame(pd.DataFrame({"t": texts}))
    assert [r.t for r in df.select("t", X.title_key(F.col("t")).alias("k")).collect() if X.fold_title(r.t) != r.k] == []
    assert df.where(X.is_plain(F.col("t"))).count() > 40_000 and len(X.plain_ranges()) < 120


def test_plain_titles_are_null_to_python(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(t):
        seen.add(int(t.notna().sum()))
        return t

    rows = spark.createDataFrame([("Plain title",), ("naïve café",), ("ﬁ",), (None,)], "t string")
    plain = X.is_plain(F.col("t"))
    rows.select(counted(F.when(~plain, F.col("t")))).collect()
    assert seen.value == 1


ROWS = [(1, "A", "a ", None), (2, "B", "ＡＢ", "b"), (3, "ab", None, ""), (4, " ", None, "ß"), (5, "SS", None, None), (6, "only", "Only", "ONLY"), (7, "x", None, None), (7, "x", None, None), (None, "none", None, None)]


def brute(rows, references):
    found = {}
    for i, *names in rows:
        for k in {X.fold_title(n) for n in names if n is not None} - {""}:
            found.setdefault(k, []).append(i)
    hits = lambda t: found.get(X.fold_title(t), []) if t is not None else []
    return sorted(((k, t, min(len(hits(t)), 2), hits(t)[0] if len(hits(t)) == 1 else None) for k, t in references), key=repr)


def test_index_and_updates(spark, tmp_path):
    references = [(k, t) for k, t in enumerate(["a", "AB", "ss", "ß", "only", "x", "none", "nothing", "", " ", None, None])] + [(100 + k, "Only") for k in range(500)]
    asked = spark.createDataFrame(references, "k long, title string")
    one = str(tmp_path / "one")
    titles.write(catalog_of(spark, ROWS), one)
    path = str(tmp_path / "0")
    titles.write(catalog_of(spark, ROWS[:1]), path)
    for n, row in enumerate(ROWS[1:], 1):  # row by row, from the index alone
        titles.update(spark, path, catalog_of(spark, [row]), str(tmp_path / str(n)))
        path = str(tmp_path / str(n))
    for p in (one, path):
        got = titles.resolve(asked, spark.read.parquet(p))
        assert sorted((tuple(r) for r in got.select("k", "title", "matches", "id").collect()), key=repr) == brute(ROWS, references)
    assert titles.resolve(asked.where("false"), spark.read.parquet(one)).count() == 0
    single = {r.title: (min(r.matches, 2), r.id) for r in search.resolve(["a", "AB", "ss", "x"], catalog_of(spark, ROWS)).collect()}
    assert single == {t: (m, i) for _, t, m, i in brute(ROWS, references) if t in single}


def test_lookups_are_whole_and_spread(spark):
    n = 40_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, n, 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice")).unionAll(spark.sql("SELECT 7L, 14L"))
    hot = joins.hot_keys(rows, "k", 100)
    assert [r.k for r in hot.collect()] == [7]
    got = joins.looked_up(rows, scratch.written(table, "t"), "k", hot)
    want = rows.join(table.withColumnRenamed("k", "_k"), F.col("k") == F.col("_k"), "left").select("k", "id", "twice")
    assert got.columns == ["k", "id", "twice"] and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == n
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < n * 0.4 and len(sizes) == 4


def test_bloom_filters_lose_nothing(spark):
    rows = spark.range(50_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    few = rows.where("xxhash64(k) % 10 = 0")
    kept = joins.may_hold(rows, "k", joins.bloom(few, "k"))
    assert few.exceptAll(kept).count() == 0 and kept.count() < few.count() + 100 and kept.columns == ["k"]
