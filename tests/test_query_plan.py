import copy

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.plans import query as Q

RULES = Q.Rules(
    genres=frozenset("ABC"), tags=frozenset(["t", "u", "v", "w"]), formats=frozenset(["TV", "OVA"]), statuses=frozenset(["FINISHED"]), year=(1900, 2100),
    groups={"G": (("u", "v"), ("any_of", "none_of"), "G_V1")},
)


def broken(path, value):
    q = Q.empty()
    at = q
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return q


@pytest.mark.parametrize(
    "path,value",
    [
        (["extra"], 1), (["reference_titles"], ("a",)), (["reference_titles"], ["a", "a"]), (["reference_titles"], [" a"]), (["reference_titles"], [""]),
        (["hard_constraints", "genres", "all_of"], [1]), (["hard_constraints", "year", "min"], True), (["hard_constraints", "year", "min"], 1.0),
        (["hard_constraints", "episodes", "max"], 0), (["hard_constraints", "year"], {"min": 2, "max": 1}), (["hard_constraints", "tags"], {"all_of": ["x"], "any_of": ["x"], "none_of": []}),
    ],
)
def test_structure_errors(path, value):
    with pytest.raises(Q.QueryError):
        Q.check_structure(broken(path, value))


def test_domain():
    Q.check_domain(Q.query(genres={"all_of": ["A"]}, formats=["TV"], year={"min": 1900}), RULES)
    for bad in (Q.query(genres={"all_of": ["D"]}), Q.query(year={"max": 2101}), Q.query(formats=["MOVIE"]), Q.query(soft_preferences=["calm"])):
        with pytest.raises(Q.QueryError):
            Q.check_domain(bad, RULES)


def test_groups_expand_under_their_operator():
    spec = Q.query(tags={"any_of": ["w"]})
    spec["hard_constraints"]["tag_groups"] = {"all_of": [], "any_of": ["G"], "none_of": []}
    before = copy.deepcopy(spec)
    built = Q.build(spec, RULES)
    assert built["hard_constraints"]["tags"]["any_of"] == ["u", "v", "w"] and spec == before
    assert Q.rule_ids(spec, RULES) == ["G_V1"] and Q.count_clauses(spec) == 1
    spec["hard_constraints"]["tag_groups"] = {"all_of": ["G"], "any_of": [], "none_of": []}
    with pytest.raises(Q.QueryError):
        Q.build(spec, RULES)
    spec["hard_constraints"]["tags"]["none_of"] = ["u"]
    spec["hard_constraints"]["tag_groups"] = {"all_of": [], "any_of": ["G"], "none_of": []}
    with pytest.raises(Q.QueryError):
        Q.build(spec, RULES)


sets = st.permutations("ABCDEF").map(lambda p: {"all_of": p[:2], "any_of": p[2:4], "none_of": p[4:5]})


@settings(max_examples=50, deadline=None)
@given(sets, sets, st.integers(1, 50) | st.none())
def test_canonical_form(genres, tags, least):
    q = Q.query(genres=genres, tags=tags, episodes={"min": least}, formats=["b", "a"])
    again = Q.canonical(Q.canonical(q))
    assert again == Q.canonical(q) and Q.dumps(q) == Q.dumps(again)
    assert Q.clauses(q) == Q.clauses(again)
    assert len(Q.clauses(q)) == Q.count_clauses(q)
    assert Q.signature(q).startswith("GENRE_ALL + GENRE_ANY + GENRE_NONE") and Q.signature(Q.empty()) == Q.NO_CONSTRAINT


def test_a_finished_spec_is_checked_once(monkeypatch):
    """finished() gives dumps() and signature() of build(), which are what they were, by one check; the spec stays."""
    rules = Q.Rules(genres=frozenset("AB"), tags=frozenset("xyz"), formats=frozenset(["TV"]), statuses=frozenset("F"), groups={"G": (("x", "y"), ("any_of",), "G_V1")})
    spec = Q.query(genres={"all_of": ["B", "A"]}, year={"min": 1990}, formats=["TV"], reference_titles=["t"])
    spec["hard_constraints"]["tag_groups"] = {"all_of": [], "any_of": ["G"], "none_of": []}
    before = repr(spec)
    gold = Q.build(spec, rules)
    want = Q.dumps(gold), Q.signature(gold)
    calls, check = [], Q.check_structure
    monkeypatch.setattr(Q, "check_structure", lambda q: calls.append(1) or check(q))
    assert Q.finished(spec, rules) == want and len(calls) == 1
    assert repr(spec) == before and gold["hard_constraints"]["tags"]["any_of"] == ["x", "y"]
