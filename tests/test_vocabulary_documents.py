"""Taxonomies, audits of tags, executable tags, pilots and predictions."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import audit, evaluation, generation, search, tag_audit
from quillon.plans import query as Q
from quillon.plans import query_columns as QC
from quillon.queries import BINDING_RULES, POOLS, RULES
from quillon.sources import catalog as C
from quillon.sources import records as R
from quillon.sources import taxonomy as T
from quillon.sources.schemas import CATALOG, QUERY

TAGS = [
    {"id": 2, "name": "Loop", "description": None, "category": "Time", "isGeneralSpoiler": False, "isAdult": False, "rank": 9},
    {"id": 1, "name": "School", "description": "d", "category": "Place", "isGeneralSpoiler": False, "isAdult": False},
    {"id": 3, "name": "Twist", "description": "d", "category": "Plot", "isGeneralSpoiler": True, "isAdult": False},
]
PAYLOAD = {"data": {"GenreCollection": ["Drama", "Action"], "MediaTagCollection": TAGS, "more": 1}}


def test_snapshot(tmp_path):
    s = T.snapshot_of(PAYLOAD)
    assert s["genres"] == ["Action", "Drama"] and [t["id"] for t in s["tags"]] == [1, 2, 3] and "rank" not in s["tags"][0]
    text = T.dumps_snapshot(s)
    assert T.load_snapshot(text) == s and T.sha256(text) == T.sha256(T.dumps_snapshot(T.load_snapshot(text)))
    for bad in ([*TAGS, TAGS[0]], [TAGS[0], TAGS[1] | {"name": "Loop"}], [TAGS[0] | {"id": True}], [TAGS[0] | {"id": 0}], [TAGS[0] | {"name": "a "}], [TAGS[0] | {"isAdult": 1}], [{"id": 1}], [TAGS[0] | {"description": 3}]):
        with pytest.raises(R.RecordError):
            T.snapshot_of({"data": {"GenreCollection": [], "MediaTagCollection": bad}})
    for payload in ({}, {"data": {}}, {"data": {"GenreCollection": ["a", "a"], "MediaTagCollection": []}}, {"data": {"GenreCollection": [" a"], "MediaTagCollection": []}}):
        with pytest.raises(R.RecordError):
            T.snapshot_of(payload)
    for wrong in (text.replace('"Action","Drama"', '"Drama","Action"'), text.replace('"id":1,"name":"School"', '"name":"School","id":1'), text.replace('{"snapshot', '{"genres":[],"snapshot', 1), text[:-1]):
        with pytest.raises(R.RecordError):
            T.load_snapshot(wrong)
    (tmp_path / "t").mkdir()
    m = T.write_snapshot(PAYLOAD, str(tmp_path / "t"), "2024-01-02T03:04:05Z", "service")
    assert m["tag_count"] == 3 and m["canonical_sha256"] == T.sha256((tmp_path / "t/canonical.json").read_text()) and json.loads((tmp_path / "t/source.json").read_text()) == PAYLOAD
    with pytest.raises(FileExistsError):
        T.write_snapshot(PAYLOAD, str(tmp_path / "t"), "2024-01-02T03:04:05Z", "service")
    assert T.fetch_payload(lambda body: (200, {}, PAYLOAD), "q") == PAYLOAD
    for answer in ((500, {}, {}), (200, {}, {"errors": [1]})):
        with pytest.raises(RuntimeError):
            T.fetch_payload(lambda body, a=answer: a, "q")


RAW = "id long, name string, description string, category string, isGeneralSpoiler boolean, isAdult boolean"


def test_projected_tags(spark):
    rows = [(2, "b", None, "c", False, False), (1, "a", "d", "c", False, True)]
    assert [tuple(r) for r in T.projected(spark.createDataFrame(rows, RAW)).collect()] == rows[::-1]
    assert T.projected(spark.createDataFrame([], RAW)).count() == 0
    for bad, fault in (((2, "z", None, "c", False, False), "id comes twice"), ((3, "a", None, "c", False, False), "name comes twice"), ((4, "x ", None, "c", False, False), "wrong field"), ((5, "x", None, None, False, False), "wrong field")):
        with pytest.raises(Exception, match=fault):
            T.projected(spark.createDataFrame([*rows, bad], RAW)).collect()


@pytest.fixture(scope="module")
def snapshot():
    return T.snapshot_of(PAYLOAD)


def reviewed(snapshot, **more):
    sha = T.sha256(T.dumps_snapshot(snapshot))
    rows = [{"tag_id": t["id"], "tag_name": t["name"], "category": t["category"], "approved": t["id"] < 3, "reason": "r", "aliases": [f"alias {t['id']}"], "is_general_spoiler": t["is_general_spoiler"], "is_adult": False, "source_snapshot_hash": sha} for t in snapshot["tags"]]
    rows[0] |= more
    return sha, T.load_audit(json.dumps(rows))


def test_audit_faults(spark, snapshot):
    tags = T.tags_table(spark, snapshot)
    sha, rows = reviewed(snapshot)
    assert tag_audit.audit_faults(T.audit_table(spark, rows), tags, sha).count() == 0
    for more, faults in (
        ({"tag_id": 9}, {"unknown id"}), ({"tag_name": "Schol"}, {"unknown name"}), ({"tag_name": "Loop"}, {"id and name are two tags", "tag_name comes twice"}), ({"category": "x"}, {"category differs"}), ({"is_adult": True}, {"is_adult differs"}),
        ({"source_snapshot_hash": "1" * 64}, {"another snapshot"}), ({"aliases": ["Loop"]}, {"an alias is a tag's name"}), ({"aliases": ["alias 2"]}, {"an alias is shared"}), ({"aliases": ["alias 3"]}, set()), ({"tag_id": 2}, {"id and name are two tags", "category differs", "tag_id comes twice"}),
    ):
        _, good = reviewed(snapshot)
        good[0] |= more
        assert {r.fault for r in tag_audit.audit_faults(T.audit_table(spark, good), tags, sha).collect()} == faults, more
    for bad in ({"approved": None}, {"aliases": ["a", "a"]}, {"aliases": [" a"]}, {"reason": ""}, {"source_snapshot_hash": "x"}, {"tag_id": "1"}):
        with pytest.raises(R.RecordError):
            reviewed(snapshot, **bad)


def test_executable_tags(spark, snapshot, tmp_path):
    sha, rows = reviewed(snapshot)
    found = tag_audit.executable(T.audit_table(spark, rows))
    subset = T.subset_document(found, "v1", sha)
    assert [t["tag_name"] for t in subset["tags"]] == ["School", "Loop"] and T.load_subset(T.dumps_subset(subset)) == subset
    (tmp_path / "s").mkdir()
    assert T.write_subset(subset, str(tmp_path / "s"))["approved_tag_count"] == 2
    for flag, match in (("is_adult", "adult"), ("is_general_spoiler", "spoiler")):
        bad = [r | {flag: r["tag_id"] == 1} for r in rows]
        with pytest.raises(Exception, match=match):
            tag_audit.executable(T.audit_table(spark, bad)).collect()
        refused = [r | {flag: r["tag_id"] == 1, "approved": False} for r in rows]
        assert tag_audit.executable(T.audit_table(spark, refused)).count() == 0
    for wrong in (subset | {"tags": subset["tags"][::-1]}, subset | {"tags": [subset["tags"][0] | {"is_adult": True}]}, subset | {"tags": [subset["tags"][0] | {"aliases": ["School"]}]}, {"tags": []}):
        with pytest.raises(R.RecordError):
            T.check_subset(wrong)
    rules = Q.Rules(genres=frozenset("A"), tags=frozenset(["School", "Loop"]), formats=frozenset(), statuses=frozenset(), groups={"G": (("Loop",), ("any_of",), "1")})
    tag_audit.check_targets(rules, found)
    with pytest.raises(Q.QueryError, match="not approved"):
        tag_audit.check_targets(Q.Rules(genres=frozenset("A"), tags=frozenset(["School", "Twist"]), formats=frozenset(), statuses=frozenset()), found)


# --- queries as columns -------------------------------------------------------------------------------------------

QUERIES = [
    Q.empty(), Q.query(genres={"all_of": ["PROMO", "SMALL"], "none_of": ["X"]}, year={"min": 1850, "max": 1990}), Q.query(tags={"any_of": ["Brand#1", "Y"]}, episodes={"max": 3}, formats=["1-URGENT"], status=["Z"]),
    Q.query(genres={"any_of": ["PROMO"]}, reference_titles=["t"], soft_preferences=["s"]), Q.query(tags={"all_of": ["Brand#1"], "any_of": ["Brand#2"], "none_of": ["Brand#3", "Brand#4"]}, year={"max": 3000}, formats=["5-LOW", "2-HIGH"]),
]


def test_query_columns_agree_with_the_driver(spark):
    rows = spark.read.schema(QUERY).json(spark.sparkContext.parallelize([json.dumps(q) for q in QUERIES], 1))
    q = F.struct(*rows.columns)
    got = rows.select(QC.signature(q).alias("s"), QC.clause_count(q).alias("n"), QC.outside(q, RULES).alias("o")).collect()
    assert [(r.s, r.n) for r in got] == [(Q.signature(x), Q.count_clauses(x)) for x in QUERIES]
    for r, x in zip(got, QUERIES, strict=True):
        try:
            Q.check_domain(x, RULES)
            assert r.o == []
        except Q.QueryError:
            assert r.o
    assert got[2].o == ["Y", "Z"] and got[1].o == ["X", "year.min"]


# --- pilots and predictions ---------------------------------------------------------------------------------------


def manifest(**more):
    cases = [{"case_id": f"case_{i:03}", "semantic_family": "cross_field_composition", "complexity_bucket": "2", "atoms": [{"kind": "genre_set", "operator": "all_of", "cardinality": 1}, {"kind": "year_range", "range_pattern": "min_only"}], "generation_family": "direct_compact_v1", "template_id": f"case_{i:03}__direct_compact_v1", "split": "train", "seeds": list(range(100 * i, 100 * i + 50))} for i in range(4)]
    cases[1] |= more
    return json.dumps({"manifest_version": "m", "dataset_version": "d", "cases": cases})


def test_pilot(spark):
    cases = R.pilot_cases(spark, R.load_pilot(manifest()))
    assert cases.count() == 200 and cases.select("seed").distinct().count() == 200
    made = generation.records(cases, "seed", BINDING_RULES, POOLS).select("*", "r.*").drop("r")
    assert made.where("error IS NOT NULL OR clauses <> 2").count() == 0 and generation.check_records(made, BINDING_RULES).count() == 0
    atoms = json.loads(manifest())["cases"][0]["atoms"]
    for more in (
        {"case_id": "case_000"}, {"case_id": "case_999"}, {"semantic_family": "normalization"}, {"complexity_bucket": "3"}, {"atoms": atoms[::-1]}, {"atoms": [atoms[0] | {"cardinality": 7}, atoms[1]]}, {"atoms": [{"kind": "x"}]}, {"atoms": [atoms[0] | {"more": 1}]},
        {"split": "challenge"}, {"template_id": "t"}, {"generation_family": "g"}, {"seeds": []}, {"seeds": [2, 1]}, {"seeds": [1, 1]}, {"seeds": [1.5]}, {"seeds": [1]}, {"seeds": list(range(500))},
    ):
        with pytest.raises(R.RecordError):
            R.load_pilot(manifest(**more))


def test_predictions_round_trip(spark, tmp_path):
    gold = Q.dumps(Q.query(genres={"all_of": ["PROMO"]}))
    raws = [gold, "no JSON \n é", gold.replace("formats", "format"), gold.replace("PROMO", "Z"), Q.dumps(Q.query(genres={"any_of": ["PROMO"]}))]
    rows = spark.createDataFrame([(f"s{i}", "test", "text", gold, r, "fam") for i, r in enumerate(raws)], "sample_id string, split string, user_text string, gold_query string, raw_output string, semantic_family string")
    made = R.prediction_rows(evaluation.evaluated(rows, RULES), {"model_id": "m", "generation_config": '{"do_sample":false}'})
    assert len(made.columns) == 27
    path = str(tmp_path / "p")
    R.write_predictions(made, path)
    back = {r.sample_id: r for r in R.read_predictions(spark, path).collect()}
    want = {r.sample_id: r for r in made.collect()}
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert [x["sample_id"] for x in lines] == sorted(want) and all(list(x) == sorted(x) and len(x) == 27 for x in lines)
    assert lines[0]["gold_query"] == json.loads(gold) and lines[1]["parsed_prediction"] is None and lines[1]["raw_model_output"] == raws[1] and lines[0]["generation_config"] == {"do_sample": False}
    for k, r in want.items():
        b = back[k]
        assert (b.exact_match, b.error_labels, b.raw_model_output, b.hard_constraint_fn, b.field_correctness) == (r.exact_match, r.error_labels, r.raw_model_output, r.hard_constraint_fn, r.field_correctness)
        assert Q.canonical(json.loads(b.gold_query)) == json.loads(gold)
    assert [bool(back[f"s{i}"].parse_error) for i in range(5)] == [False, True, False, False, False] and back["s2"].schema_error and back["s3"].domain_error
    with pytest.raises(Exception, match="exists"):
        R.write_predictions(made, path)
    (tmp_path / "bad.jsonl").write_text('{"split":"x"}')
    with pytest.raises(Exception, match="sample id"):
        R.read_predictions(spark, str(tmp_path / "bad.jsonl")).collect()


# --- audits -------------------------------------------------------------------------------------------------------


def test_first_unused_has_one_row_for_each_text(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (None, "b", "n"), (2, None, "t"), (3, "used", "u")], "pos int, text string, more string")
    got = audit.first_unused(rows, spark.createDataFrame([("used",)], "text string"), "text", "pos")
    assert got.columns == rows.columns and sorted((r.pos or 0, r.text) for r in got.collect()) == [(0, "b"), (1, "a")]


def test_nearest_rank_and_audit(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], ["x"] * (i % 3)) for i in range(1, 11)], "v long, k string, l array<string>")
    for p in (0.01, 0.1, 0.5, 0.51, 0.95, 1.0):
        assert audit.nearest_rank(rows, "v", {"x": p}).first().x == sorted(range(1, 11))[-int(-p * 10 // 1) - 1]
    for p in (0, 1.1):
        with pytest.raises(ValueError):
            audit.nearest_rank(rows, "v", {"x": p})
    assert {(r.k, r.n, r.distinct, r.several) for r in audit.dataset_audit(rows, "k", "v", "l").collect()} == {("a", 5, 5, 2), ("b", 5, 5, 1)}
    assert audit.outside(rows.withColumn("k", F.when(F.col("v") > 1, F.col("k"))), "k", spark.createDataFrame([("a",), ("a",)], "k string")).count() == 5


def test_digest_of_a_table_with_large_keys(spark):
    rows = spark.createDataFrame([(k, "x") for k in (0, 3, 4**9, 4**9 + 1)], "k long, v string")
    same = C.table_sha256(rows.repartition(3), "k", 4).first()
    assert C.table_sha256(rows, "k", 4).first() == same and C.table_sha256(rows.withColumn("v", F.lit("y")), "k", 4).first() != same


def test_the_same_row_twice_is_no_match(spark):
    row = {"id": 1, "title": {"romaji": "Title 1", "english": "TITLE 1"}, "genres": ["A"], "tags": []}
    make = lambda *rows: spark.read.schema(CATALOG).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    once, twice = (search.resolve(["title 1"], make(*[row] * n)).first() for n in (1, 2))
    assert (once.matches, once.id) == (1, 1) and (twice.matches, twice.id) == (2, None)
    facts = [search.corpus_facts(["title 1", "none"], make(*[row] * n)).first() for n in (1, 2)]
    assert (facts[0]._refs, facts[0]._genres) == (1, ["A"]) and (facts[1]._refs, facts[1]._genres) == (0, [])


def test_joined(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r.j for r in rows.select(X.joined(F.col("x"), ", ", " or ").alias("j")).collect()] == ["", "a", "a or b", "a, b or c"]


def test_fidelity(spark):
    a, b, c = (Q.dumps(Q.query(genres=g)) for g in ({"all_of": ["A"]}, {"any_of": ["A"]}, {"all_of": ["B"]}))
    rows = spark.createDataFrame([("ok", a, a, [1, 2], [1]), ("ok", b, a, [1], [1, 3]), ("ok", c, a, None, None), ("parse_failed", None, a, None, [1])], "status string, parsed string, expected string, result_ids array<long>, allowed_ids array<long>")
    judged = evaluation.fidelity(rows)
    assert [(r.exact, r.semantic, r.violations) for r in judged.collect()] == [(True, True, [2]), (False, True, []), (False, False, []), (False, False, [])]
    assert tuple(evaluation.fidelity_counts(judged).first()) == (3, 1, 2, 4, 1)


# --- domains, pages and frozen configurations ---------------------------------------------------------------------


def test_real_domain(spark):
    from quillon.operators import domain
    from quillon.plans import sampler as S
    from quillon.queries import CONFIG

    rows = [{"id": i, "title": {"romaji": f"Title {i}"}, "genres": ["Drama"], "tags": [{"name": n, "rank": r} for n, r in t], "popularity": i} for i, t in ((1, [("School", 80), ("Twist", 90)]), (2, [("Loop", 20)]), (3, []))]
    catalog = spark.read.schema(CATALOG).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    config = json.loads(json.dumps(CONFIG))
    config["operator_cardinality"] = CONFIG["operator_cardinality"]
    config["genre_sampling"]["priority_weights"], config["tag_sampling"]["priority_weights"], config["tag_sampling"]["value_tiers"] = {"Drama": 2}, {}, {"School": "core"}
    groups = {"G": (("School",), ("any_of", "none_of"), "G1")}
    made = domain.real_domain(spark, PAYLOAD, {"School": ["campus"], "Loop": []}, catalog, config, ["TV"], ["FINISHED"], groups, (1900, 2100), "v1")
    assert made["rules"].tags == {"School"} and [t["tag_name"] for t in made["subset"]["tags"]] == ["School", "Loop"] and made["titles"] == ["Title 1", "Title 2", "Title 3"]
    assert [r["approved"] for r in made["audit"]] == [True, True, False] and T.load_audit(json.dumps(made["audit"])) == made["audit"]
    with pytest.raises(Exception, match="spoiler"):
        domain.real_domain(spark, PAYLOAD, {"Twist": []}, catalog, config, ["TV"], ["FINISHED"], groups, (1900, 2100), "v1")
    with pytest.raises(R.RecordError, match="lacks"):
        domain.real_domain(spark, PAYLOAD, {"Nothing": []}, catalog, config, ["TV"], ["FINISHED"], groups, (1900, 2100), "v1")
    with pytest.raises(S.SamplerError):
        domain.real_domain(spark, PAYLOAD, {"School": []}, catalog, CONFIG, ["TV"], ["FINISHED"], groups, (1900, 2100), "v1")


def test_authored_cases(spark):
    from quillon.operators import domain

    spec = Q.query(genres={"all_of": ["PROMO"]}, year={"min": 1995})
    grouped = Q.empty()
    grouped["hard_constraints"]["tag_groups"] = {"all_of": [], "any_of": ["LOW"], "none_of": []}
    got = domain.authored_cases(spark, [("c1", "promo since 1995", spec), ("c2", "low", grouped)], BINDING_RULES).orderBy("challenge_id").collect()
    assert [(r.signature, r.clauses) for r in got] == [("GENRE_ALL + YEAR_MIN", 2), ("TAG_ANY", 1)] and json.loads(got[1].gold_query)["hard_constraints"]["tags"]["any_of"] == ["Brand#1", "Brand#2"]
    for bad in ([("c", "a", spec), ("c", "b", spec)], [("c", "a", spec), ("d", "a", spec)], [("c", " ", spec)]):
        with pytest.raises(R.RecordError):
            domain.authored_cases(spark, bad, BINDING_RULES)
    with pytest.raises(Q.QueryError):
        domain.authored_cases(spark, [("c", "a", Q.query(genres={"all_of": ["Z"]}))], BINDING_RULES)


def test_pages_are_checked():
    good = {"pageInfo": {"hasNextPage": False}, "media": [{"id": 1}]}
    send = lambda page: lambda body: (200, {}, {"data": {"Page": page}})
    assert R.fetch_page(send(good), {}) == good
    for more in ({"page": 0}, {"page": True}, {"per_page": 51}, {"per_page": 0}, {"timeout": 0}):
        with pytest.raises(ValueError):
            R.fetch_page(send(good), {}, **more)
    for bad in (None, [], {}, {"pageInfo": None, "media": []}, {"pageInfo": {"hasNextPage": 1}, "media": []}, {"pageInfo": {"hasNextPage": True}, "media": None}, {"pageInfo": {"hasNextPage": True}, "media": [None]}):
        with pytest.raises(RuntimeError):
            R.fetch_page(send(bad), {}, sleep=lambda s: None)
    with pytest.raises(RuntimeError):
        R.fetch_page(lambda body: (200, {}, {"data": None}), {})


def test_frozen_configurations():
    kinds = {"a": int, "b": (int, float), "c": bool, "d": str}
    text = '{"a":1,"b":0.5,"c":true,"d":"x"}'
    assert R.load_frozen(text, kinds, {"d": "x"})["b"] == 0.5
    for bad in (text.replace("1,", "true,"), text.replace('"x"', "3"), text.replace("0.5", '"y"'), text.replace(',"d":"x"', "")):
        with pytest.raises(R.RecordError):
            R.load_frozen(bad, kinds)
    with pytest.raises(R.RecordError, match="fixed"):
        R.load_frozen(text, kinds, {"d": "y"})


def test_a_catalog_of_other_bytes_is_refused(spark, tmp_path):
    import hashlib

    row = {"id": 1, "title": {"romaji": "a"}, "genres": [], "tags": []}
    (tmp_path / "c.jsonl").write_text(json.dumps(row) + "\n")
    path, sha = str(tmp_path / "c.jsonl"), hashlib.sha256((tmp_path / "c.jsonl").read_bytes()).hexdigest()
    assert C.file_sha256(spark, path) == sha and C.file_sha256(spark, str(tmp_path)) is None and C.file_sha256(spark, path + "x") is None
    assert C.read_catalog(spark, path, sha, 1).count() == 1
    for wrong in ((path, "0" * 64, 1), (str(tmp_path), sha, 1), (path, sha, 2)):
        with pytest.raises(C.CatalogError):
            C.read_catalog(spark, *wrong)
