import json

import pytest

from quillon.plans import query as Q
from quillon.sources import records as R

RULES = {
    "rules_version": "v", "schema_version": "s", "executable_subset_version": "e", "executable_subset_hash": "h",
    "taxonomy": {"genres": ["A", "B"], "tags": ["x", "y"], "formats": ["TV"], "statuses": ["F"], "soft_preferences": []},
    "tag_groups": {"G": {"tags": ["x", "y"], "allowed_operators": ["any_of"], "normalization_rule_id": "G1"}},
    "numeric_rules": {"year": {"minimum": 1900, "maximum": 2100}, "episodes": {"minimum": 1, "maximum": None}},
}


def test_strict_documents():
    assert R.load_strict('{"a":1,"b":2}', ("b", "a")) == {"a": 1, "b": 2}
    for text, keys, order in (('{"a":1,"a":2}', None, False), ("[1]", None, False), ("{", None, False), ('{"a":1}', ("b",), False), ('{"a":1,"b":2}', ("b", "a"), True)):
        with pytest.raises(R.RecordError):
            R.load_strict(text, keys, order)


def test_rules():
    rules = R.load_rules(json.dumps(RULES))
    assert rules.groups["G"] == (("x", "y"), ("any_of",), "G1") and rules.year == (1900, 2100) and rules.sha256() == R.load_rules(json.dumps(RULES)).sha256()
    bad = json.loads(json.dumps(RULES))
    bad["tag_groups"]["G"]["tags"] = ["z"]
    with pytest.raises(Q.QueryError):
        R.load_rules(json.dumps(bad))
    bad = json.loads(json.dumps(RULES))
    bad["taxonomy"]["genres"] = ["A", "A "]
    with pytest.raises(R.RecordError):
        R.load_rules(json.dumps(bad))


def test_files(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    R.write_bundle({a: "1"})
    with pytest.raises(FileExistsError):
        R.write_bundle({b: "2", a: "3"})
    assert not (tmp_path / "b").exists()
    R.write_pretty(a, {"é": 1})
    assert (tmp_path / "a").read_text() == '{\n  "é": 1\n}\n'
    assert R.title_pool('{"pool_version":"1","titles":["a","b"]}') == ["a", "b"]
    for titles in (["b", "a"], ["a", "a"], [" a"]):
        with pytest.raises(R.RecordError):
            R.title_pool(json.dumps({"pool_version": "1", "titles": titles}))
    assert R.manifest(1, {"v": "1"}, {}, "2024-01-02T03:04:05Z")["rows"] == 1
    with pytest.raises(R.RecordError):
        R.utc_timestamp("2024-01-02 03:04:05")
    assert "| b | 1 |" in R.markdown("t", {"x": [("b", 1), ("a", 2)]})


def test_tables(spark, tmp_path):
    gold = Q.dumps(Q.query(genres={"all_of": ["A"]}))
    (tmp_path / "in.jsonl").write_text("\n".join([json.dumps({"challenge_id": "c1", "user_text": "x", "gold_query": json.loads(gold)}), json.dumps({"sample_id": "s1", "split": "test", "user_text": "y", "gold_query": json.loads(gold), "constraint_count": 2})]))
    rows = R.read_inputs(spark, str(tmp_path / "in.jsonl"), "challenge").orderBy("sample_id").collect()
    assert [(r.sample_id, r.split, r.constraint_count) for r in rows] == [("c1", "challenge", None), ("s1", "test", 2)] and Q.canonical(json.loads(rows[0].gold_query)) == json.loads(gold)
    (tmp_path / "tr.jsonl").write_text("\n".join(json.dumps({"sample_id": f"s{i}", "user_text": "x", "gold_query": json.loads(gold), "dataset_version": "1"}) for i in range(3)))
    assert R.read_training(spark, str(tmp_path / "tr.jsonl"), "train", 3, {"dataset_version": "1"}).count() == 3
    for rows, version in ((4, "1"), (3, "2")):
        with pytest.raises(R.RecordError):
            R.read_training(spark, str(tmp_path / "tr.jsonl"), "train", rows, {"dataset_version": version})
    with pytest.raises(PermissionError):
        R.read_training(spark, str(tmp_path / "tr.jsonl"), "test", 3, {})
    R.write_records(spark.createDataFrame([(2, "b"), (1, None)], "z long, a string"), str(tmp_path / "out"), "z")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":null,"z":1}', '{"a":"b","z":2}']
    (tmp_path / "p.txt").write_text("prompt \n\r\n")
    assert R.read_prompt(spark, str(tmp_path / "p.txt")) == "prompt "


def page(last, n=1):
    return {"data": {"Page": {"pageInfo": {"hasNextPage": not last}, "media": [{"id": n}]}}}


def test_crawl_retries_and_ends():
    waits, answers = [], iter([(429, {"Retry-After": "7"}, {}), (200, {}, page(False)), ConnectionError(), (200, {}, page(True, 2)), (200, {}, page(True, 3))])

    def send(body):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    got = list(R.crawl(send, [({}, 5), ({}, 5)], sleep=waits.append))
    assert [(p["schedule"], p["page"]) for p in got] == [(0, 1), (0, 2), (1, 1)] and waits == [7.0, 3.0]
    for bad in ((404, {}, {}), (200, {}, {"errors": [1]}), (200, {}, {"data": {}})):
        with pytest.raises(RuntimeError):
            list(R.crawl(lambda b, bad=bad: bad, [({}, 1)], sleep=waits.append))
    with pytest.raises(RuntimeError):
        R.posted(lambda b: (503, {}, {}), {}, sleep=waits.append)
