import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import audit, evaluation, patterns, sampling, sft
from quillon.plans import query as Q
from quillon.queries import CARDINALITY_W, OPERATOR_W, RANGE_W
from quillon.sources import catalog as C
from quillon.sources.schemas import CATALOG

GOLD = Q.query(genres={"all_of": ["A"], "any_of": ["B", "C"]}, year={"min": 1990})
RULES = Q.Rules(genres=frozenset("ABCD"), tags=frozenset("x"), formats=frozenset(), statuses=frozenset(), year=(1900, 2100))


def outcome(raw):
    return evaluation.evaluate(raw, Q.dumps(GOLD), RULES)


def test_layers():
    good = Q.dumps(GOLD)
    e = outcome(good)
    assert e["exact"] and (e["tp"], e["fp"], e["fn"]) == (3, 0, 0) and e["labels"] == []
    for raw, label in ((good + " x", "JSON_PARSE_ERROR"), (good.replace("formats", "format"), "SCHEMA_ERROR"), (good.replace('"A"', '"Z"'), "DOMAIN_ERROR")):
        e = outcome(raw)
        assert e["labels"] == [label] and not e["exact"] and e["fn"] == 3 and e["recoverable"]
    e = outcome(Q.dumps(Q.query(genres={"any_of": ["A"]}, year={"min": 1991})))
    assert e["labels"] == ["MISSING_CONSTRAINT", "HALLUCINATED_CONSTRAINT", "WRONG_OPERATOR", "WRONG_VALUE", "WRONG_NUMERIC_BOUND"]
    assert not outcome("nothing here")["recoverable"]
    assert outcome('[1]')["error"] == "top-level JSON value must be an object"


def test_metrics_of_nothing(spark):
    rows = spark.createDataFrame([(0, 0, 0, True)], "tp long, fp long, fn long, exact boolean")
    m = evaluation.metrics(rows, ("exact",)).first()
    assert (m.precision, m.recall, m.f1, m.exact_rate) == (1.0, 1.0, 1.0, 1.0)


def test_folded_singletons():
    assert evaluation.folded_singletons(Q.query(tags={"any_of": ["x"]})) == Q.query(tags={"all_of": ["x"]})
    with pytest.raises(PermissionError):
        evaluation.authorised("test", False)


# The counts of eligible patterns, by family and bucket.
COUNTS = {
    "single_constraint": [0, 14, 0, 0, 0, 0], "same_field_logic": [0, 8, 4, 2, 0, 0], "cross_field_composition": [0, 0, 77, 276, 595, 3125],
    "normalization": [0, 8, 98, 520, 1610, 22340], "reference_only": [1, 0, 0, 0, 0, 0], "reference_composition": [0, 14, 83, 278, 595, 3125],
}


def test_pattern_space(spark):
    space = patterns.space(spark)
    got = {(r.family, r.bucket): r["count"] for r in patterns.eligible(space).groupBy("family", "bucket").count().collect()}
    assert got == {(f, b): n for f, ns in COUNTS.items() for b, n in zip(patterns.BUCKETS, ns, strict=True) if n}
    assert space.count() == 32768 and space.select("pos").distinct().count() == 32768


def test_mechanics_follow_support_not_counts(spark):
    m = patterns.mechanics(patterns.space(spark), OPERATOR_W, CARDINALITY_W, RANGE_W)
    rows = m.where("family = 'same_field_logic' AND bucket = '1' AND signature = 'genre_set'").select("genre_set", "p").collect()
    p = {r.genre_set: r.p for r in rows}
    assert p["all_of:1"] == pytest.approx(0.45) and p["any_of:2"] + p["any_of:3"] == pytest.approx(0.30) and p["none_of:1"] == pytest.approx(0.25)


class Counting(random.Random):
    draws = 0

    def random(self):
        self.draws += 1
        return super().random()


def test_forced_choices_take_no_draw():
    r = Counting(1)
    assert sampling.draw(r, ["a"], [3.0]) == "a" and r.draws == 0
    got = sampling.draw_without(r, list("abc"), [1, 1, 1], 3)
    assert got == list("abc") and r.draws == 2


def test_seeded_choices_repeat(spark):
    rows = spark.range(20)
    a, b = (sampling.seeded_choices(rows, "id", list("abcdef"), [1.0] * 6, 3).orderBy("id").collect() for _ in range(2))
    assert a == b and all(len(set(r.drawn)) == 3 and r.drawn == sorted(r.drawn) for r in a)


def test_split_is_a_partition(spark):
    rows = sampling.shuffled_split(spark.range(1003), "id", 5)
    got = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    assert got == {"train": 802, "validation": 100, "test": 101} and rows.select("id").distinct().count() == 1003


def test_features(spark):
    rows = spark.createDataFrame([(1, [1, 2], [1, 2, 3]), (1, [1], [1, 9, 9, 9])], "b int, p array<int>, f array<int>")
    got = sft.padded(sft.features(rows, "p", "f", 10), "b", 0).orderBy(F.size("p").desc()).collect()
    assert got[0].labels == [-100, -100, 3, -100] and got[0].input_ids == [1, 2, 3, 0] and got[0].attention_mask == [1, 1, 1, 0]
    for p, f in (([2], [1, 2]), ([1], [1]), ([1], list(range(1, 12)))):
        with pytest.raises(Exception, match="prefix|completion|too long"):
            sft.features(spark.createDataFrame([(1, p, f)], "b int, p array<int>, f array<int>"), "p", "f", 10).collect()
    assert sft.length_limit(1708) == 1792


def test_text_functions(spark):
    rows = spark.createDataFrame([(" a\t", 0, ""), (None, None, None)], "s string, n int, e string")
    r = rows.select(X.stripped(F.col("s")).alias("s"), X.or_else(F.col("n"), F.lit(7)).alias("n"), X.or_else(F.col("e"), F.lit("x")).alias("e"), X.title_key(F.col("s")).alias("k")).collect()
    assert r[0].asDict() == {"s": "a", "n": 7, "e": "x", "k": "a"} and r[1].s is None and r[1].n == 7
    assert X.fold_title(" Ｓtraße ") == "strasse"
    assert X.parse_strictly('{"a":1} x')[0] is None and X.recoverable('```json\n{"a":1}\n```')


def test_catalog_round_trip(spark, tmp_path):
    rows = [{"id": i, "title": {"romaji": f"é{i}"}, "genres": ["b", "a", "a"], "tags": [{"name": "z"}, {"name": "y", "rank": 3}], "startDate": {"year": 0}, "seasonYear": 2001} for i in (3, 1, 2)]
    raw = spark.read.schema(CATALOG).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    good = C.normalise(raw)
    C.write_lines(good, str(tmp_path / "c"))
    again = C.read_catalog(spark, str(tmp_path / "c"), rows=3)
    r = again.orderBy("id").first()
    assert r.year == 2001 and r.genres == ["a", "b"] and [(t.name, t.rank) for t in r.tags] == [("y", 3), ("z", 0)]
    assert C.table_sha256(again, "id").first() == C.table_sha256(good, "id").first()
    with pytest.raises(Exception, match="exists"):
        C.write_lines(good, str(tmp_path / "c"))
    for bad in (raw.union(raw), raw.where("false"), raw.withColumn("genres", F.lit(None).cast("array<string>"))):
        with pytest.raises(C.CatalogError):
            C.check(bad)
    kept, dropped = C.split_bad(raw.withColumn("tags", F.lit(None).cast("array<struct<name:string,rank:int>>")))
    assert kept.count() == 0 and {x.violation for x in dropped.collect()} == {"tags"}


def test_pages_last_write_wins(spark, tmp_path):
    def page(s, p, *media):
        return json.dumps({"schedule": s, "page": p, "data": {"Page": {"pageInfo": {"hasNextPage": False}, "media": list(media)}}})

    a = {"id": 1, "title": {"romaji": "a"}, "genres": [], "tags": [], "popularity": 1}
    (tmp_path / "1.json").write_text(page(0, 1, a, a | {"id": 2, "isAdult": True}))
    (tmp_path / "2.json").write_text(page(1, 1, a | {"popularity": 5}))
    assert [(r.id, r.popularity) for r in C.read_pages(spark, str(tmp_path)).collect()] == [(1, 5)]


def test_hygiene(spark):
    rows = spark.createDataFrame([("train", "a"), ("train", "a"), ("test", "b"), ("test", "b"), ("validation", "a")], "split string, text string")
    keys = {"text": F.col("text")}
    bad = audit.hygiene_errors(audit.split_overlap(rows, "split", keys), audit.duplicate_excess(rows, "split", keys))
    assert {(r["where"], r.n) for r in bad.collect()} == {("train/validation", 1), ("test", 1)}


def test_choose_covers_the_unit_interval(spark):
    table = spark.createDataFrame([("c", 0, "a", 1.0), ("c", 1, "b", 3.0)], "ctx string, ord int, o string, w double")
    draws = spark.createDataFrame([("c", 0.0), ("c", 0.2499), ("c", 0.25), ("c", 0.999999)], "ctx string, u double")
    assert [r.o for r in sampling.choose(draws, table, "ctx", "o", "w", "ord").orderBy("u").collect()] == ["a", "a", "b", "b"]


def test_generated_dataset(spark):
    from quillon.operators import generation as G
    from quillon.queries import BINDING_RULES, POOLS

    space = patterns.eligible(patterns.space(spark)).where("bucket = '2'")
    used = spark.createDataFrame([("nothing",)], "text string")
    a = G.dataset(space, "pos", BINDING_RULES, POOLS, used)
    rows = a.collect()
    assert rows and len({r.text for r in rows}) == len(rows) == len({r.sample_id for r in rows})
    assert G.check_records(a, BINDING_RULES).count() == 0
    assert G.check_records(a.withColumn("signature", F.lit("x")), BINDING_RULES).count() == len(rows)
    again = G.dataset(space, "pos", BINDING_RULES, POOLS, a.select("text").limit(5))
    assert again.count() <= len(rows) and {r.sample_id for r in again.collect()} - {r.sample_id for r in rows} <= {r.sample_id for r in again.collect()}
    impossible = {s: None for s in patterns.SLOTS} | {"tag_group_any": "used", "n": 1}
    with pytest.raises(Q.QueryError):
        G.bind(impossible, 1, RULES, POOLS)


def test_texts_follow_the_slots():
    from quillon.operators import generation as G

    spec = Q.query(genres={"all_of": ["A", "B"]}, tags={"none_of": ["T"]}, year={"min": 1990, "max": 2000}, formats=["X", "Y"], reference_titles=["R"])
    spec["hard_constraints"]["tag_groups"] = {"all_of": [], "any_of": ["LOW"], "none_of": []}
    texts = [G.styled(spec, k, {"formats": {"X": "eks"}}) for k in range(len(G.STYLES))]
    assert len(set(texts)) == len(texts)
    en = next(t for t, s in zip(texts, G.STYLES, strict=True) if s[0] == "en" and s[2] == "; ")
    assert en.split(" ", 4)[-1] == "genre A and B; no theme T; kind LOW; year 1990 or more; year 2000 or less; format eks or Y; likeness to R"


def test_every_user_turn_has_messages(spark):
    from quillon.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").collect()
    want = {(t.conv_id, t.turn): [{"role": "system", "content": "S"}, {"role": "user", "content": t.text}] for t in turns}
    got = QUERIES["prj8_every_message"](spark, sf).collect()
    assert any("\n" in t.text for t in turns) and len(got) == len(turns)
    assert {(r.conv_id, r.turn): json.loads(r.messages) for r in got} == want


def test_dataset_is_what_one_attempt_after_the_other_gives(spark):
    from quillon.operators import generation as G
    from quillon.queries import BINDING_RULES, NAMES, POOLS

    space = patterns.eligible(patterns.space(spark)).where("bucket IN ('0', '1')")
    assert space.count() == 45  # eight of its patterns are of two families
    tried = [r.asDict() for r in G.attempts(space, "pos", 20).orderBy("place").collect()]
    assert len(tried) == 900 and len({r["draw_seed"] for r in tried}) > 890
    turns = space.orderBy("pos", "family").collect()
    assert [(r["pos"], r["family"], r["place"]) for r in tried] == [(p.pos, p.family, k * 45 + i) for k in range(20) for i, p in enumerate(turns)]
    used = G.dataset(space, "pos", BINDING_RULES, POOLS, spark.createDataFrame([], "text string"), names=NAMES).select("text").limit(30).collect()
    taken, want = {r.text for r in used}, []
    for r in tried:
        rng = random.Random(r["draw_seed"])
        spec = G.bind(r, rng, BINDING_RULES, POOLS)
        G.widen(spec, rng, BINDING_RULES)
        style = rng.randrange(len(G.STYLES))
        text = G.styled(spec, style, NAMES if rng.random() < 0.75 else {})
        if text not in taken and len(want) < 60:
            taken.add(text)
            want.append((r["place"], r["family"], text, Q.dumps(Q.build(spec, BINDING_RULES))))
    got = G.dataset(space, "pos", BINDING_RULES, POOLS, spark.createDataFrame(used), 60, NAMES)
    assert [(r.place, r.family, r.text, r.gold) for r in got.orderBy("place").collect()] == want and len(want) == 60
    assert G.check_records(got, BINDING_RULES).count() == 0
    wide = [Q.query(formats=["5-LOW"]) for _ in range(500)]
    for k, spec in enumerate(wide):
        G.widen(spec, random.Random(k), BINDING_RULES)
    two = [len(w["hard_constraints"]["formats"]) for w in wide].count(2)
    assert 60 < two < 140 and not any(w["hard_constraints"]["status"] for w in wide)
    few = space.where("family = 'reference_only'")
    with pytest.raises(ValueError, match="fresh"):
        G.dataset(few, "pos", BINDING_RULES, POOLS, spark.createDataFrame([], "text string"), 100).count()


def test_dataset_query_has_every_pattern_family(spark):
    from quillon.queries import QUERIES

    rows = QUERIES["smp18_dataset"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 32773 == len({r.text for r in rows}) == len({r.sample_id for r in rows})
    assert {r.family for r in rows} == set(patterns.FAMILIES) and {min(r.clauses, 5) for r in rows} == set(range(6))
