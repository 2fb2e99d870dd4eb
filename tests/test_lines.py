"""Line numbers over many splits, faults by line, positions of rows, and runs paired by position."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation
from quillon.plans import query as Q
from quillon.sources import catalog as C
from quillon.sources import lines
from quillon.sources import records as R


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of some hundred bytes, several of them in one task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_lines_of_many_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(2), []
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n"), ("c.txt", "\n")):
        texts = ["x" * rng.choice([0, 1, 5, 90, 2000]) + f"{name}{k}" if rng.random() < 0.9 else "" for k in range(300 if name != "c.txt" else 1)]
        texts[-1] = f"last of {name}"
        (tmp_path / name).write_bytes(end.join(texts).encode() + (end.encode() if name == "a.txt" else b""))
        want += [(name, k + 1, t) for k, t in enumerate(texts)]
    got = lines.numbered(spark, str(tmp_path))
    assert got.select(F.spark_partition_id()).distinct().count() > 20
    rows = sorted((r.row, r.file.rsplit("/", 1)[-1], r.line, r.value) for r in got.collect())
    assert rows == [(k + 1, *w) for k, w in enumerate(want)]


CATALOG_LINE = {"id": 1, "title": {"romaji": "a", "english": None}, "genres": ["A"], "tags": [], "year": None}


def test_faults_of_a_catalog(spark, tmp_path, small_splits):
    faulty = {
        5: ('{"id":5', "no JSON"), 6: ("[1]", "no JSON object"), 7: ('{"id":7}}', "no JSON"), 8: ('{"id":8},{"id":9}', "no JSON"), 9: ('{"id":9}],[{}', "no JSON"), 10: ("3", "no JSON object"), 11: ('"x"', "no JSON object"), 12: ("null", "no JSON object"),
        20: (json.dumps(CATALOG_LINE | {"id": "20"}), "id is no whole number"), 21: (json.dumps({k: v for k, v in CATALOG_LINE.items() if k != "id"}), "id is no whole number"), 22: (json.dumps(CATALOG_LINE | {"id": True}), "id is no whole number"), 23: (json.dumps(CATALOG_LINE | {"id": 1.5}), "id is no whole number"),
        24: (json.dumps(CATALOG_LINE | {"id": 24, "genres": None}), "genres is no list"), 25: (json.dumps(CATALOG_LINE | {"id": 25, "title": "x"}), "title is no object"), 26: (json.dumps(CATALOG_LINE | {"id": 26, "tags": {}}), "tags is no list"),
        27: (json.dumps(CATALOG_LINE | {"id": 27, "title": {"romaji": 3}}), "title.romaji is no text"), 28: (json.dumps(CATALOG_LINE | {"id": 28, "year": "1990"}), "year is no whole number"), 150: (json.dumps(CATALOG_LINE | {"id": 3}), "the id of row 3"), 151: (json.dumps(CATALOG_LINE | {"id": 3}), "the id of row 3"),
    }
    texts = [faulty[k][0] if k in faulty else "  " if k % 50 == 0 else json.dumps(CATALOG_LINE | {"id": k}) for k in range(1, 201)]
    path = str(tmp_path / "c.jsonl")
    (tmp_path / "c.jsonl").write_text("\n".join(texts) + "\n")
    assert sorted((r.line, r.reason) for r in C.line_faults(spark, path).collect()) == [(k, reason) for k, (_, reason) in sorted(faulty.items())]
    with pytest.raises(C.CatalogError, match="c.jsonl:5: no JSON; c.jsonl:6: no JSON object"):
        C.read_catalog(spark, path)
    (tmp_path / "good.jsonl").write_text("\n".join(t for k, t in enumerate(texts, 1) if k not in faulty))
    assert C.read_catalog(spark, str(tmp_path / "good.jsonl"), rows=200 - len(faulty) - 3).count() == 200 - len(faulty) - 3


def test_faults_of_training_records(spark, tmp_path):
    gold = json.loads(Q.dumps(Q.query(genres={"all_of": ["A"]})))
    good = {"sample_id": "s", "user_text": "x", "gold_query": gold}
    cases = [good, good | {"sample_id": " s"}, good | {"sample_id": 3}, good | {"user_text": ""}, good | {"gold_query": "x"}, good | {"gold_query": gold | {"more": 1}}, {k: v for k, v in good.items() if k != "user_text"}, good | {"sample_id": "t"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, cases)) + "\n\nnot JSON")
    got = {r.line: r.reason for r in R.training_faults(spark, str(tmp_path / "t.jsonl")).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6, 7, 10] and got[2].startswith("sample_id") and got[6].startswith("gold_query: query has wrong keys") and got[10] == "no JSON"
    with pytest.raises(R.RecordError, match=r"t\.jsonl:2: sample_id"):
        R.read_training(spark, str(tmp_path / "t.jsonl"), "train", 8, {})


def test_positions(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 1000).alias("k"), "id").repartition(7)
    got = lines.positions(rows, ["k", "id"]).collect()
    want = sorted((r.k, r.id) for r in rows.collect())
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.row)] == want and sorted(r.row for r in got) == list(range(1, 5001))
    assert lines.positions(rows.where("false"), ["k"]).count() == 0


def test_runs_by_position(spark):
    make = lambda *rows: spark.createDataFrame(rows, "row long, sample_id string, user_text string, exact boolean")
    base = make((1, "a", "x", True), (2, "b", None, False), (3, "c", "z", True))
    tuned = make((1, "a", "x", False), (2, "c", None, False), (3, "b", "y", True))
    got = {r.row: (r.b_sample_id, r.t_sample_id, r.faults) for r in evaluation.zipped(base, tuned, ["sample_id", "user_text"]).collect()}
    assert got == {1: ("a", "a", []), 2: ("b", "c", ["sample_id"]), 3: ("c", "b", ["sample_id", "user_text"])}
    assert evaluation.zipped(base.where("false"), tuned.where("false"), ["sample_id"]).count() == 0
    for wrong in (make((1, "a", "x", True)), make((1, "a", "x", True), (2, "b", "x", True), (2, "c", "x", True)), make((1, "a", "x", True), (2, "b", "x", True), (4, "c", "x", True))):
        with pytest.raises(ValueError):
            evaluation.zipped(base, wrong, ["sample_id"])


def test_lines_are_parsed_once(spark, tmp_path):
    """A filter on faults doesn't bring the parse of a line back into the scan, once for each rule."""
    (tmp_path / "a.txt").write_text('{"id": 1}\n{"id": "x"}\n\n[1]\n{"id": 2} 3\n')
    found = lines.faults(lines.numbered(spark, str(tmp_path)), {"id is no whole number": lines.kind_of("id") != "BIGINT"})
    assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.line, r.reason) for r in found.orderBy("row").collect()] == [(2, "id is no whole number"), (4, "no JSON object"), (5, "no JSON")]
