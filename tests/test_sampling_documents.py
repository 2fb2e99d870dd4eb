"""Configurations, policies, samplers and the values they bind, against plain versions."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import Counting

from quillon.operators import generation as G
from quillon.operators import patterns as P
from quillon.operators import samplers
from quillon.plans import query as Q
from quillon.plans import sampler as S
from quillon.queries import CONFIG, SHARING_RULES, signature_policy


@pytest.fixture(scope="module")
def space(spark):
    return P.space(spark).cache()


@pytest.fixture(scope="module")
def policy(space):
    return signature_policy(space)


@pytest.fixture(scope="module")
def sampler(space, policy):
    return samplers.Sampler(CONFIG, policy, space)


def changed(document, path, value):
    made = json.loads(json.dumps(document))
    *way, last = path.split(".")
    at = made
    for k in way:
        at = at[k]
    at[last] = value
    return json.dumps(made)


def test_config():
    loaded = S.load_config(json.dumps(CONFIG))
    assert loaded == CONFIG and loaded["operator_cardinality"]["all_of"] == {1: 65, 2: 30, 3: 5}
    S.check_config_domain(loaded, SHARING_RULES)
    for path, value in (
        ("seed", True), ("seed", 1.5), ("sampler_version", " v"), ("sampler_version", ""), ("family_weights.normalization", 0), ("family_weights.other", 1), ("operator_weights.all_of", float("inf")), ("operator_weights.all_of", True),
        ("operator_cardinality.any_of.1", 1), ("operator_cardinality.any_of", {"2": 1}), ("genre_sampling.maximum_value_share", 1.5), ("genre_sampling.minimum_coverage_per_value", 0), ("genre_sampling.tier_weights", {}),
        ("tag_sampling.value_tiers", {"x": "best"}), ("tag_sampling.priority_weights", {" x": 1}), ("numeric_sampling.year.common_values", []), ("numeric_sampling.year.common_values", [2010, 2000]), ("numeric_sampling.year.common_values", [1990]),
        ("numeric_sampling.episodes.common_values", [True]), ("numeric_sampling.year.pool_weights", {"common": 1}), ("audit_tolerances.maximum_signature_share", 0), ("constraint_count_weights", [1]),
    ):
        with pytest.raises(ValueError):
            S.load_config(changed(CONFIG, path, value))
    with pytest.raises(ValueError):
        S.load_config(json.dumps(CONFIG)[:-1] + ',"seed":17}')
    for path, value in (("genre_sampling.priority_weights", {"Z": 1}), ("tag_sampling.value_tiers", {"Z": "core"}), ("numeric_sampling.year.long_tail_values", [1800])):
        with pytest.raises(S.SamplerError, match="outside"):
            S.check_config_domain(S.load_config(changed(CONFIG, path, value)), SHARING_RULES)


def test_weights_of_values_and_tables(spark):
    assert S.value_weights(CONFIG, "tags", frozenset(["Brand#1", "Brand#2", "Brand#3"])) == {"Brand#1": 3.0, "Brand#2": 5.0, "Brand#3": 1.0}
    assert S.value_weights(CONFIG, "genres", frozenset(["PROMO", "SMALL"])) == {"PROMO": 2.0, "SMALL": 1.0}
    rows = S.weight_table(spark, CONFIG).where("`table` = 'cardinality.any_of'").orderBy("ord").collect()
    assert [(r.key, r.weight) for r in rows] == [("2", 80.0), ("3", 20.0)]


def test_shares_are_bounded():
    S.check_shares(CONFIG, "genres", SHARING_RULES.genres)
    with pytest.raises(S.SamplerError, match="share"):
        S.check_shares(CONFIG, "genres", frozenset(["PROMO", "SMALL"]))  # 2 of 3
    with pytest.raises(S.SamplerError, match="share"):
        G.Pools.of(json.loads(json.dumps(CONFIG)) | {"operator_cardinality": CONFIG["operator_cardinality"], "genre_sampling": CONFIG["genre_sampling"] | {"maximum_value_share": 0.1}}, SHARING_RULES, ["t"])


def test_policy(space, policy):
    text = json.dumps(policy)
    assert S.load_policy(text) == policy
    sha = S.policy_sha256(policy)
    S.check_policy(policy, sha)
    floats = json.loads(text)
    floats["signature_entries"][0]["weight"] = 1.0
    assert S.policy_sha256(floats) == sha
    entries = policy["signature_entries"]
    bad = [entries[::-1], [entries[0], entries[0]], [entries[0] | {"weight": 0}], [entries[0] | {"weight": 2**53 + 1}], [entries[0] | {"complexity_bucket": 1}], [entries[0] | {"complexity_bucket": "0"}], [entries[0] | {"atom_kinds": []}],
           [entries[0] | {"atom_kinds": ["tag_set", "genre_set"]}], [entries[0] | {"atom_kinds": ["genre_set", "genre_set"]}], [entries[0] | {"semantic_family": "other"}], [entries[0] | {"more": 1}]]
    for wrong in bad:
        with pytest.raises(S.SamplerError):
            S.check_policy(policy | {"signature_entries": wrong})
    with pytest.raises(S.SamplerError, match="digest"):
        S.check_policy(policy, "0" * 64)
    S.check_policy_domain(policy, CONFIG, space)
    with pytest.raises(S.SamplerError, match="versions"):
        S.check_policy_domain(policy | {"sampler_version": "x"}, CONFIG, space)
    with pytest.raises(S.SamplerError, match="fit"):
        S.check_policy_domain(policy | {"signature_entries": entries[1:2]}, CONFIG, space)


def test_families_of_one_filling(space):
    rows = P.eligible(space).groupBy("pos", *P.SLOTS, "n").agg(F.sort_array(F.collect_list("family")).alias("f")).where("pos % 7 = 3").collect()
    for r in rows:
        slots = {s: r[s] for s in P.SLOTS}
        assert P.clauses(slots) == r.n and sorted(P.families(slots)) == list(r.f)


def test_draws_are_counted(sampler):
    r = Counting(3)
    plans = Counter()
    for _ in range(3000):
        before = r.draws
        family, bucket = sampler.plan(r)
        assert r.draws - before == (1 if family == "reference_only" else 2)
        plans[family] += 1
    assert abs(plans["single_constraint"] / 3000 - 0.25) < 0.04 and set(plans) == set(P.FAMILIES)
    r = Counting(1)
    assert sampler.signature(r, "reference_only", "0") == "reference" and r.draws == 0
    assert sampler.mechanics(r, "reference_only", "0", "reference")["reference"] == "used" and r.draws == 0
    found = sampler.mechanics(r, "single_constraint", "1", "genre_set")
    assert found["genre_set"].endswith(":1") and r.draws == 1  # an operator of two; one value is the only cardinality left
    r = Counting(1)
    sampler.mechanics(r, "cross_field_composition", "3", "genre_set+year_range")
    assert 1 <= r.draws <= 3
    r = Counting(1)
    assert samplers.operator_cardinality(r, CONFIG, "3") == ("all_of", 3) and r.draws == 0
    with pytest.raises(S.SamplerError):
        samplers.operator_cardinality(r, CONFIG, "4")


def test_mechanics_follow_their_distribution(spark, sampler, space):
    """Frequencies of draws against the table of probabilities."""
    table = P.mechanics(space, CONFIG["operator_weights"], CONFIG["operator_cardinality"], S.ranges(CONFIG))
    for family, bucket, signature in (("same_field_logic", "1", "genre_set"), ("cross_field_composition", "3", "genre_set+year_range"), ("normalization", "2", "tag_set+tag_group_any")):
        p = {r.pos: r.p for r in table.where(f"family = '{family}' AND bucket = '{bucket}' AND signature = '{signature}'").select("pos", "p").collect()}
        rng = random.Random(5)
        got = Counter(sampler.mechanics(rng, family, bucket, signature)["pos"] for _ in range(6000))
        assert set(got) <= set(p) and all(abs(got[k] / 6000 - x) < 0.03 for k, x in p.items())


def test_drawn_patterns_depend_on_the_seed_alone(spark, sampler):
    rows = spark.range(200).repartition(7)
    a = {r.id: r.pattern for r in samplers.drawn_patterns(rows, "id", sampler).collect()}
    for i in range(0, 200, 13):
        want = sampler.pattern(random.Random(i))
        assert a[i].asDict() == {k: want[k] for k in samplers.DRAWN.names}
    faults = P.plan_faults(samplers.drawn_patterns(rows, "id", sampler).select("pattern.*"))
    assert faults.count() == 0


def test_plan_faults(spark, space):
    good = P.eligible(space).withColumn("signature", F.array_join(P.signature(), "+")).where("pos % 50 = 1")
    assert P.plan_faults(good).count() == 0
    for column, value, fault in (("genre_set", "'all_of:4'", "no such option"), ("n", "n + 9", "another clause count"), ("bucket", "'x'", "another bucket"), ("signature", "'reference'", "another signature"), ("family", "'reference_only'", "the family can't have it")):
        bad = good.where("genre_set IS NOT NULL").withColumn(column, F.expr(value))
        assert {r.fault for r in P.plan_faults(bad).select("fault").distinct().collect()} == {fault}


# --- binding ------------------------------------------------------------------------------------------------------


def plain_pairs(pattern, rules):
    any_, none = ([g for g in sorted(rules.groups) if o in rules.groups[g][1]] if pattern[s] else [None] for s, o in (("tag_group_any", "any_of"), ("tag_group_none", "none_of")))
    out, need = [], int((pattern["tag_set"] or ":0").split(":")[1])
    for a in any_:
        for b in none:
            ta, tb = (set(rules.groups[g][0]) if g else set() for g in (a, b))
            if not (a and a == b) and not ta & tb and len(rules.tags - ta - tb) >= need:
                out.append((a, b))
    return out


def test_groups_that_share_tags_never_end_a_bindable_pattern():
    pools = G.Pools({"A": 1.0}, {t: 1.0 for t in SHARING_RULES.tags}, [2000], [12], ["t"])
    both = dict.fromkeys(P.SLOTS) | {"tag_group_any": "used", "tag_group_none": "used", "n": 2}
    assert G.group_pairs(both, SHARING_RULES) == plain_pairs(both, SHARING_RULES) == [("A", "B")]
    for seed in range(200):
        hard = G.bind(both, seed, SHARING_RULES, pools)["hard_constraints"]
        assert hard["tag_groups"] == {"all_of": [], "any_of": ["A"], "none_of": ["B"]}
    one = dict.fromkeys(P.SLOTS) | {"tag_group_none": "used", "n": 1}
    got = Counter(G.bind(one, seed, SHARING_RULES, pools)["hard_constraints"]["tag_groups"]["none_of"][0] for seed in range(900))
    assert set(got) == {"A", "B", "C"} and min(got.values()) > 230
    few = Q.Rules(genres=frozenset("A"), tags=frozenset("xyz"), formats=frozenset("T"), statuses=frozenset("F"), groups={"G": (("x", "y"), ("any_of",), "1"), "H": (("z",), ("any_of",), "2")})
    tight = dict.fromkeys(P.SLOTS) | {"tag_set": "none_of:2", "tag_group_any": "used", "n": 3}
    assert G.group_pairs(tight, few) == plain_pairs(tight, few) == [("H", None)]
    with pytest.raises(Q.QueryError):
        G.bind(tight | {"tag_set": "all_of:3", "n": 4}, 1, few, G.Pools({"A": 1.0}, dict.fromkeys("xyz", 1.0), [2000], [1], ["t"]))


def test_numbers_come_from_pools():
    pools = G.Pools.of(CONFIG, SHARING_RULES, ["t"])
    pattern = dict.fromkeys(P.SLOTS) | {"year_range": "bounded_range", "n": 2}
    years, low, high = CONFIG["numeric_sampling"]["year"], Counter(), Counter()
    for seed in range(4000):
        r = Counting(seed)
        y = G.bind(pattern, r, SHARING_RULES, pools)["hard_constraints"]["year"]
        low[y["min"]] += 1
        if y["min"] == 1990:
            high[y["max"]] += 1
        assert y["min"] <= y["max"] and r.draws <= 3
    assert abs(sum(low[v] for v in years["common_values"]) / 4000 - 0.6) < 0.03 and abs(low[1917] / 4000 - 0.1) < 0.02
    base = {2000: 0.2, 2010: 0.2, 2020: 0.2, 1990: 0.15, 2005: 0.15}
    assert all(abs(high[v] / sum(high.values()) - p / sum(base.values())) < 0.07 for v, p in base.items()) and set(high) <= set(base)
    r = Counting(0)
    G.bind(dict.fromkeys(P.SLOTS) | {"year_range": "min_only", "n": 1}, r, SHARING_RULES, G.Pools({}, {}, [2000], [1], []))
    assert r.draws == 0


def test_sampled_records_are_right_and_whole_records_are_checked(spark, sampler, space):
    pools = G.Pools.of(CONFIG, SHARING_RULES, ["t", "u"])
    rows = G.sampled_records(spark.range(60), "id", sampler, SHARING_RULES, pools).select("id", "r.*").collect()
    for r in rows:
        rng = random.Random(r.id)
        p = sampler.pattern(rng)
        spec = G.bind(p, rng, SHARING_RULES, pools)
        assert (r.family, r.pos, r.error, r.clauses, r.gold) == (p["family"], p["pos"], None, p["n"], Q.dumps(Q.build(spec, SHARING_RULES)))
    made = G.records(P.eligible(space).where("pos % 400 = 1"), "pos", SHARING_RULES, pools).select("*", "r.*").drop("r", "error")
    made = G.identified(made, ["gold", "text", "pos"])
    n = made.count()
    assert n and G.check_records(made, SHARING_RULES, ["gold", "text", "pos"]).count() == 0
    other = Q.dumps(Q.query(genres={"all_of": ["PROMO"]}))
    for column, value, fault in (("clauses", F.col("clauses") + 1, "clauses differs"), ("signature", F.lit("x"), "signature differs"), ("rule_ids", F.array(F.lit("x")), "rule_ids differs"), ("gold", F.lit(other), "gold differs"), ("sample_id", F.lit("x"), "sample_id differs")):
        bad = G.check_records(made.withColumn(column, value), SHARING_RULES, ["gold", "text", "pos"]).select("fault").collect()
        assert len(bad) >= n - 1 and {r.fault for r in bad} <= {fault, "signature differs" if column == "gold" else fault}


def test_draws_are_spread_over_tasks(spark, sampler):
    """Rows of one split are drawn in many tasks."""
    from quillon.operators import samplers

    pools = G.Pools.of(CONFIG, SHARING_RULES, ["t", "u"])
    rows = spark.range(0, 64, 1, 1)
    for made in (G.sampled_records(rows, "id", sampler, SHARING_RULES, pools), samplers.drawn_patterns(rows, "id", sampler)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
