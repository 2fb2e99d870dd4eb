"""Files that a manifest leaves out, against the plain filter."""

import random

import pytest

from quillon import queries as R
from quillon.operators import search
from quillon.plans import query as Q
from quillon.sources import scratch, skipping

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    c = scratch.written(R.catalog(spark, SF), "catalog")
    path = scratch.new_path(spark, "skipping")
    skipping.write(c, path, files=24)
    return c, path


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_same_rows_from_fewer_files(spark, stored):
    c, path = stored
    rng, genres, tags = random.Random(1), ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], [f"Brand#{k}" for k in range(1, 26)]
    total, read = skipping.manifest(spark, path).count(), []
    assert total >= 20
    for k in range(14):
        g, t = rng.sample(genres, 4), rng.sample(tags, 5)
        q = Q.query(
            genres={"all_of": g[: k % 3], "none_of": g[3:] if k % 2 else []}, tags={"any_of": t[:2] if k % 4 == 0 else [], "none_of": t[3:] if k % 5 == 0 else []},
            year={"min": 1995} if k % 3 == 0 else {}, formats=["5-LOW"] if k % 2 else [], status=["P"] if k % 7 == 0 else []
        )
        found = skipping.execute(spark, path, q)
        assert ids(found) == ids(search.execute(q, c))
        files = skipping.files_for(spark, path, q)
        assert {f.rsplit("/", 1)[-1] for f in found.inputFiles()} <= {f.rsplit("/", 1)[-1] for f in files}
        read.append(len(files))
    assert sum(read) < 0.75 * total * len(read)
    q = Q.query(genres={"all_of": ["ECONOMY"], "none_of": ["PROMO", "SMALL", "LARGE"]}, formats=["5-LOW"])
    assert len(skipping.files_for(spark, path, q)) < total / 2


def test_no_file_and_every_file(spark, stored):
    _, path = stored
    assert skipping.execute(spark, path, Q.query(genres={"all_of": ["nowhere"]})).count() == 0
    assert skipping.files_for(spark, path, Q.query(year={"min": 2500})) == [] and len(skipping.files_for(spark, path, Q.query())) == skipping.manifest(spark, path).count()
    with pytest.raises(Exception, match="exists"):
        skipping.write(spark.read.parquet(f"{path}/rows"), path)


def test_many_terms_share_bits(spark, stored, monkeypatch):
    """With fewer bits than terms nothing is lost and nothing is said to be in all rows that isn't."""
    c, _ = stored
    monkeypatch.setattr(skipping, "TERMS", 16)
    path = scratch.new_path(spark, "skipping")
    skipping.write(c, path, files=8)
    for q in (Q.query(genres={"all_of": ["PROMO"], "none_of": ["SMALL"]}), Q.query(tags={"none_of": ["Brand#3"]}, formats=["5-LOW"])):
        assert ids(skipping.execute(spark, path, q)) == ids(search.execute(q, c))
