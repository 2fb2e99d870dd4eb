"""The pipeline against a brute-force version, stage for stage."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_corpus_operators import linked, naive_fingerprint
from tokenizers import Tokenizer

from quillon.llm import encoders, packing, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    score = net.score([t.encode() for _, t in rows])
    rows = [r for r, s in zip(rows, score, strict=True) if s >= 0.7]
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    rows = [(i, t) for i, t in rows if first[re.sub(r"[\x20\x09-\x0D]+", " ", t)] == i]
    label = linked([naive_fingerprint(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    tok, want = Tokenizer.from_file(encoders.path_of(encoders.BYTE_BPE)), []
    for i, t in rows:
        ids = np.array([*tok.encode(pii.masked(t, pii.spans(t)), add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(packing.cuts(len(ids), 1024))]
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and len(fill) <= 1.05 * got.length.sum() / 1024 + 1


def test_stages_keep_the_columns_and_survive_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "trained", lambda docs, labels: quality.train([b"good text", b"%%% ###"], [1, 0], steps=20))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.withColumn("text", F.lit(None).cast("string")).unionByName(docs.withColumn("text", F.lit(""))).unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, odd.where("false"), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, SF).count() >= odd.count() and last(spark, odd.where("false"), SF).count() == 0
    masked = corpus_pipeline.personal_data(spark, odd, SF)
    assert isinstance(masked.toPandas(), pd.DataFrame) and masked.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0


def test_two_calls_in_two_threads(spark):
    """Neither takes the other's tables away."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda _: corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect(), range(2)))
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1])) and len(got[0]) > 50


def test_scratch_tables_of_calls(spark):
    from quillon.llm import common

    outside = set(common.given())
    with common.collected() as made:
        common.written(spark.range(3), "a")
        with common.collected() as inner:
            kept = common.written(spark.range(4), "b")
        assert len(made) == 2 and len(inner) == 1
        common.drop_scratch(spark, made[0])
        assert kept.count() == 4 and made == inner
    assert set(common.given()) - outside == set(made)
    common.drop_scratch(spark, *made)
    assert set(common.given()) == outside
