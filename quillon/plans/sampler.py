"""Documents that steer sampling: a configuration of weights, and a policy of the signatures that may be drawn.

Both are small JSON documents, checked on the driver against one table of their parts; nothing is repaired.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import patterns as P
from quillon.plans import query as Q
from quillon.sources.records import load_strict

# The keys of both documents and of their parts, and which cardinalities, tiers, pools and tolerances there are.
CONFIG = (
    "sampler_version", "seed", "family_weights", "constraint_count_weights", "operator_weights", "operator_cardinality", "genre_sampling", "tag_sampling",
    "numeric_sampling", "combination_policy_version", "audit_tolerances",
)
CARDINALITIES = {"all_of": (1, 2, 3), "any_of": (2, 3), "none_of": (1, 2)}
VALUE_POLICY = ("minimum_coverage_per_value", "maximum_value_share", "default_weight", "priority_weights")
TAG_POLICY = (*VALUE_POLICY, "tier_weights", "value_tiers")
TIERS = ("core", "standard", "edge")
POOLS = {"common": "common_values", "catalog_region": "catalog_region_values", "long_tail": "long_tail_values"}
NUMERIC_POLICY = ("pattern_weights", "pool_weights", *POOLS.values())
TOLERANCES = (
    "family_max_absolute_error", "constraint_count_max_absolute_error", "operator_max_absolute_error", "minimum_value_coverage_ratio",
    "maximum_signature_share"
)
POLICY = ("policy_version", "sampler_version", "signature_entries")
ENTRY = ("semantic_family", "complexity_bucket", "atom_kinds", "weight")


class SamplerError(ValueError):
    """What a document of sampling has wrong."""


# --- what a value may be ------------------------------------------------------------------------------------------


def _text(value, name: str) -> None:
    if not isinstance(value, str) or not value or value != value.strip():
        raise SamplerError(f"{name} is no text, or empty, or has outer white space: {value!r}")


def _whole(value, name: str) -> None:
    if type(value) is not int:
        raise SamplerError(f"{name} is no whole number: {value!r}")


def _count(value, name: str) -> None:
    _whole(value, name)
    if value < 1:
        raise SamplerError(f"{name} is below 1")


def _weight(value, name: str) -> None:
    if type(value) not in (int, float) or not math.isfinite(value) or value <= 0:
        raise SamplerError(f"{name} is no finite number above 0: {value!r}")


def _share(value, name: str) -> None:
    _weight(value, name)
    if value > 1:
        raise SamplerError(f"{name} exceeds 1")


def _tier(value, name: str) -> None:
    if value not in TIERS:
        raise SamplerError(f"{name} is none of {TIERS}: {value!r}")


def _keyed(of: Callable, keys: tuple | None = None) -> Callable:
    """A mapping whose values are `of`; with just these keys, or with texts as keys."""

    def check(value, name: str) -> None:
        if not isinstance(value, dict):
            raise SamplerError(f"{name} is no mapping")
        if keys is not None and set(value) != set(keys):
            raise SamplerError(f"{name} has wrong keys: {sorted(map(str, set(value) ^ set(keys)))}")
        for k, v in value.items():
            if keys is None:
                _text(k, f"a key of {name}")
            of(v, f"{name}.{k}")

    return check


def _parts(**parts: Callable) -> Callable:
    """A mapping with just these parts."""

    def check(value, name: str) -> None:
        _keyed(lambda v, n: None, tuple(parts))(value, name)
        for k, of in parts.items():
            of(value[k], f"{name}.{k}")

    return check


def _pool(value, name: str) -> None:
    if not isinstance(value, list) or not value:
        raise SamplerError(f"{name} is no list, or empty")
    for v in value:
        _count(v, name)
    if any(a >= b for a, b in zip(value, value[1:], strict=False)):
        raise SamplerError(f"{name} does not ascend")


_values = dict(zip(VALUE_POLICY, (_count, _share, _weight, _keyed(_weight)), strict=True))
_numbers = _parts(pattern_weights=_keyed(_weight, P.RANGE_OPTIONS), pool_weights=_keyed(_weight, tuple(POOLS)), **dict.fromkeys(POOLS.values(), _pool))
_CHECKS = {
    "sampler_version": _text, "seed": _whole, "combination_policy_version": _text,
    "family_weights": _keyed(_weight, tuple(P.FAMILIES)), "constraint_count_weights": _keyed(_weight, P.BUCKETS[1:]), "operator_weights": _keyed(_weight, Q.OPERATORS),
    "operator_cardinality": _parts(**{o: _keyed(_weight, c) for o, c in CARDINALITIES.items()}),
    "genre_sampling": _parts(**_values), "tag_sampling": _parts(**_values, tier_weights=_keyed(_weight, TIERS), value_tiers=_keyed(_tier)),
    "numeric_sampling": _parts(year=_numbers, episodes=_numbers), "audit_tolerances": _parts(**dict.fromkeys(TOLERANCES, _share)),
}


# --- configuration ------------------------------------------------------------------------------------------------


def check_config(config: dict) -> None:
    """Raises SamplerError unless config has just its keys, types and ranges, and pools that share no number."""
    _parts(**_CHECKS)(config, "config")
    for field, policy in config["numeric_sampling"].items():
        numbers = [v for pool in POOLS.values() for v in policy[pool]]
        if len(set(numbers)) < len(numbers):
            raise SamplerError(f"pools of {field} share a number")


def load_config(text: str) -> dict:
    """The configuration of a JSON document; cardinalities become whole numbers."""
    config = load_strict(text, CONFIG)
    table = config["operator_cardinality"]
    if isinstance(table, dict):
        for o, weights in table.items():
            if isinstance(weights, dict):
                if not all(k in ("1", "2", "3") for k in weights):
                    raise SamplerError(f"operator_cardinality.{o} has keys that are no cardinalities")
                table[o] = {int(k): w for k, w in weights.items()}
    check_config(config)
    return config


def check_config_domain(config: dict, rules: Q.Rules) -> None:
    """check_config(), and what it names is in the rules: values with a priority or tier, numbers, a group for normalisation."""
    check_config(config)
    named = [
        ("genre_sampling", "priority_weights", rules.genres), ("tag_sampling", "priority_weights", rules.tags),
        ("tag_sampling", "value_tiers", rules.tags)
    ]
    for part, key, allowed in named:
        if unknown := sorted(set(config[part][key]) - allowed):
            raise SamplerError(f"{part}.{key} has values outside the rules: {unknown}")
    for field, policy in config["numeric_sampling"].items():
        low, high = getattr(rules, field)
        if wrong := [v for pool in POOLS.values() for v in policy[pool] if low is not None and v < low or high is not None and v > high]:
            raise SamplerError(f"numbers of {field} are outside the rules: {wrong}")
    if not rules.groups:
        raise SamplerError("normalization has a weight, and the rules have no tag group")


def weight_rows(config: dict) -> list[tuple[str, str, float, int]]:
    """(table, key, weight, ord) of the weight tables, in canonical order of each."""
    tables = {
        "family": (P.FAMILIES, config["family_weights"]), "bucket": (P.BUCKETS[1:], config["constraint_count_weights"]),
        "operator": (Q.OPERATORS, config["operator_weights"])
    }
    tables |= {f"cardinality.{o}": (c, config["operator_cardinality"][o]) for o, c in CARDINALITIES.items()}
    for field, policy in config["numeric_sampling"].items():
        tables |= {f"{field}.pattern": (P.RANGE_OPTIONS, policy["pattern_weights"]), f"{field}.pool": (POOLS, policy["pool_weights"])}
    tables["tier"] = (TIERS, config["tag_sampling"]["tier_weights"])
    return [(name, str(k), float(weights[k]), i) for name, (order, weights) in tables.items() for i, k in enumerate(order)]


def weight_table(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame(weight_rows(config), "table string, key string, weight double, ord int")


def ranges(config: dict) -> dict[str, dict[str, float]]:
    """The weights of range forms by slot."""
    return {f"{field}_range": policy["pattern_weights"] for field, policy in config["numeric_sampling"].items()}


def value_weights(config: dict, field: str, values: frozenset[str]) -> dict[str, float]:
    """The weight of each value: its priority, else that of its tier (tags), else the default."""
    policy = config["genre_sampling" if field == "genres" else "tag_sampling"]
    tiers, of = policy.get("tier_weights", {}), policy.get("value_tiers", {})
    return {v: float(policy["priority_weights"].get(v, tiers.get(of.get(v), policy["default_weight"]))) for v in sorted(values)}


def check_shares(config: dict, field: str, values: frozenset[str]) -> None:
    """Raises SamplerError where a value's share of all weights exceeds the greatest allowed one."""
    weights = value_weights(config, field, values)
    most, total = config["genre_sampling" if field == "genres" else "tag_sampling"]["maximum_value_share"], sum(weights.values())
    if wrong := [v for v, w in weights.items() if w > most * total]:
        raise SamplerError(f"{field} have values of too large a share: {wrong}")


def number_pools(config: dict, field: str) -> list[tuple[float, list[int]]]:
    """(weight, numbers) of each pool."""
    policy = config["numeric_sampling"][field]
    return [(float(policy["pool_weights"][pool]), policy[key]) for pool, key in POOLS.items()]


# --- policy of signatures -----------------------------------------------------------------------------------------


def _canonical_weight(value, name: str) -> float:
    """The same float for 1 and 1.0; whole numbers that no float is equal to are refused."""
    if type(value) not in (int, float):
        raise SamplerError(f"{name} is no number: {value!r}")
    try:
        found = float(value)
    except OverflowError:
        raise SamplerError(f"{name} is too large") from None
    _weight(found, name)
    if found != value:
        raise SamplerError(f"{name} is no exact float: {value!r}")
    return found


def check_signature(kinds) -> None:
    """A signature names slots, each once, in their order."""
    if not isinstance(kinds, (list, tuple)) or not kinds or any(k not in P.SLOTS for k in kinds):
        raise SamplerError(f"no signature: {kinds!r}")
    places = [P.SLOTS.index(k) for k in kinds]
    if any(a >= b for a, b in zip(places, places[1:], strict=False)):
        raise SamplerError(f"the slots of a signature are not in order, or come twice: {kinds!r}")


def check_plan(family, bucket) -> None:
    """A family, and a bucket that it may have; 0 is a number, the others are texts."""
    if family not in P.FAMILIES or type(bucket) is not (int if bucket == 0 else str) or str(bucket) not in P.FAMILIES[family]:
        raise SamplerError(f"no family and bucket: {family!r}, {bucket!r}")


def check_policy(policy: dict, sha256: str | None = None) -> None:
    """Raises SamplerError unless entries are plans and signatures in canonical order, each once, of this digest if given."""
    _keyed(lambda v, n: None, POLICY)(policy, "policy")
    _text(policy["policy_version"], "policy_version")
    _text(policy["sampler_version"], "sampler_version")
    if not isinstance(policy["signature_entries"], list):
        raise SamplerError("signature_entries is no list")
    families, before = list(P.FAMILIES), None
    for i, e in enumerate(policy["signature_entries"]):
        _keyed(lambda v, n: None, ENTRY)(e, f"entry {i}")
        check_plan(e["semantic_family"], e["complexity_bucket"])
        check_signature(e["atom_kinds"])
        _canonical_weight(e["weight"], f"the weight of entry {i}")
        place = (families.index(e["semantic_family"]), P.BUCKETS.index(str(e["complexity_bucket"])), [P.SLOTS.index(k) for k in e["atom_kinds"]])
        if before is not None and place <= before:
            raise SamplerError(f"entry {i} comes twice, or not in canonical order")
        before = place
    if sha256 is not None and sha256 != policy_sha256(policy):
        raise SamplerError("the digest is not that of the policy")


def policy_sha256(policy: dict) -> str:
    """The digest of the policy as compact JSON in key order, with floats as weights."""
    entries = [{k: e[k] for k in ENTRY} | {"weight": _canonical_weight(e["weight"], "weight")} for e in policy["signature_entries"]]
    shown = json.dumps({k: policy[k] for k in POLICY[:2]} | {"signature_entries": entries}, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(shown.encode()).hexdigest()


def load_policy(text: str) -> dict:
    policy = load_strict(text, POLICY)
    check_policy(policy)
    return policy


def policy_table(spark: SparkSession, policy: dict) -> DataFrame:
    """family, bucket, signature (slots joined by +), weight, ord of each entry."""
    rows = [
        (e["semantic_family"], str(e["complexity_bucket"]), "+".join(e["atom_kinds"]), float(e["weight"]), i) for i,
        e in enumerate(policy["signature_entries"])
    ]
    return spark.createDataFrame(rows, "family string, bucket string, signature string, weight double, ord int")


def policy_faults(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """(family, bucket, signature, fault): signatures that no eligible pattern has, and contexts that have no entry."""
    possible = P.signatures(patterns)
    wrong = entries.join(possible, ["family", "bucket", "signature"], "left_anti").select("family", "bucket", "signature", F.lit("not eligible").alias("fault"))
    bare = possible.select("family", "bucket").distinct().join(entries, ["family", "bucket"], "left_anti")
    return wrong.unionByName(bare.select("family", "bucket", F.lit(None).cast("string").alias("signature"), F.lit("no signature").alias("fault")))


def check_policy_domain(policy: dict, config: dict, patterns: DataFrame) -> None:
    """check_policy() and check_config(), of one version, and no policy_faults()."""
    check_policy(policy)
    check_config(config)
    if policy["sampler_version"] != config["sampler_version"]:
        raise SamplerError("policy and configuration are of two versions")
    found = policy_faults(policy_table(patterns.sparkSession, policy), patterns).limit(5).collect()
    if found:
        raise SamplerError(f"signatures don't fit: {[tuple(r) for r in found]}")


def signature_probabilities(entries: DataFrame) -> DataFrame:
    """entries with p, the weight's share of its family and bucket."""
    return entries.withColumn("p", P.normalised(F.col("weight"), "family", "bucket"))
