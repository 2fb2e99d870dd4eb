"""The evaluator's semantics on a small catalog."""

import json

import pytest

from quillon.operators import search as S
from quillon.operators.service import recommend
from quillon.plans import query as Q
from quillon.sources.schemas import CATALOG
from quillon.streaming import catalog_stream, matches


def item(i, genres, tags=(), **more):
    row = {"id": i, "title": {"romaji": f"Title {i}"}, "genres": genres, "tags": [{"name": n, "rank": r} for n, r in tags], "year": 2020, "episodes": 12, "format": "TV", "status": "FINISHED", "popularity": 100, "averageScore": 80}
    return row | more


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.read.schema(CATALOG).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


ROWS = [
    item(1, ["Mystery", "Sci-Fi"], [("Cyborgs", 80)]),
    item(2, ["Mystery"], year=2010, episodes=24),
    item(3, ["Sci-Fi"], year=None, episodes=None, format="MOVIE"),
]
WEAK = item(4, [], [("Cyborgs", 10)])


def ids(df):
    return sorted(r.id for r in df.collect())


CASES = [
    ({"genres": {"all_of": ["Mystery", "Sci-Fi"]}}, [1]),
    ({"genres": {"any_of": ["Mystery", "Sci-Fi"]}}, [1, 2, 3]),
    ({"genres": {"none_of": ["Mystery"]}}, [3]),
    ({"tags": {"all_of": ["Cyborgs"]}}, [1]),
    ({"tags": {"any_of": ["Cyborgs"]}}, [1]),
    ({"tags": {"none_of": ["Cyborgs"]}}, [2, 3]),
    ({"year": {"min": 2010, "max": 2020}, "episodes": {"max": 24}}, [1, 2]),
    ({"episodes": {"min": 13}}, [2]),
    ({"formats": ["TV", "MOVIE"], "status": ["FINISHED", "RELEASING"]}, [1, 2, 3]),
    ({"formats": ["TV"], "tags": {"none_of": ["Cyborgs"]}}, [2]),
    ({"reference_titles": ["Title 1"]}, [1, 2, 3]),
    ({}, [1, 2, 3]),
]


@pytest.mark.parametrize("parts,want", CASES)
def test_filters(make, parts, want):
    assert ids(S.execute(Q.query(**parts), make(*ROWS))) == want


def test_a_weak_tag_proves_nothing_and_excludes(make):
    rows = make(WEAK)
    assert ids(S.execute(Q.query(tags={"all_of": ["Cyborgs"]}), rows)) == []
    assert ids(S.execute(Q.query(tags={"none_of": ["Cyborgs"]}), rows)) == []


def test_null_lists_are_empty(make):
    rows = make(item(1, None) | {"tags": None})
    assert ids(S.execute(Q.query(genres={"none_of": ["X"]}, tags={"none_of": ["Y"]}), rows)) == [1]


def test_references(make):
    rows = make(*ROWS, item(5, ["A"], title={"romaji": "Ｔｉｔｌｅ 9", "english": "title 9"}))
    got = {r.title: (r.matches, r.id) for r in S.resolve(["TITLE 1 ", "missing", "title 9"], rows).collect()}
    assert got == {"TITLE 1 ": (1, 1), "missing": (0, None), "title 9": (1, 5)}
    twice = make(*ROWS, ROWS[0] | {"id": 7})
    assert S.resolve(["Title 1"], twice).first().id is None


def test_rank_is_independent_of_order(make):
    q = Q.query(reference_titles=["Title 1"])
    a, b = (S.rank(q, c, c).orderBy(S.F.desc("score"), "id").collect() for c in (make(*ROWS), make(*ROWS[::-1])))
    assert [(r.id, r.score) for r in a] == [(r.id, r.score) for r in b]
    assert a[0].id == 1 and a[0].components.reference_similarity == pytest.approx(2.0)


def test_top_needs_a_sane_k(make):
    with pytest.raises(ValueError):
        S.top(Q.empty(), make(*ROWS), 0)


RULES = Q.Rules(genres=frozenset(["Mystery", "Sci-Fi"]), tags=frozenset(["Cyborgs"]), formats=frozenset(["TV"]), statuses=frozenset(["FINISHED"]), year=(1900, 2100))


def test_service(make):
    c = make(*ROWS)
    good = Q.dumps(Q.query(genres={"any_of": ["Mystery"]}, reference_titles=["nothing"]))
    assert recommend("x", lambda t: "```json\n" + good + "\n```", c, RULES)["status"] == "parse_failed"
    assert recommend("x", lambda t: good.replace("Mystery", "TV"), c, RULES)["status"] == "validation_failed"
    assert recommend("x", lambda t: Q.dumps(Q.query(year={"min": 2099})), c, RULES)["status"] == "no_matches"
    got = recommend("x", lambda t: good, c, RULES, 1)
    assert got["status"] == "ok" and got["candidates"] == 2 and len(got["results"]) == 1 and got["warnings"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r) for r in ROWS))
    q = matches(Q.query(genres={"all_of": ["Mystery"]}), catalog_stream(spark, str(tmp_path / "in"))).select("id")
    run = q.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert ids(spark.table("found")) == [1, 2]
