"""Seeded draws of what a query is like before it has values: family and bucket, signature, mechanics.

Each row's draws come from random.Random(seed), one after the other, so rows are drawn in parallel and in any order. A family
and its bucket take one draw each (a family with bucket 0 takes none for it); at every later choice one draw if there is
more than one option, none if there is one.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import patterns as P
from quillon.operators.sampling import draw, spread, weighted
from quillon.plans import query as Q
from quillon.plans import sampler as S

DRAWN = T.StructType().add("family", "string").add("bucket", "string").add("signature", "string").add("pos", "integer").add("n", "integer")
for _slot in P.SLOTS:
    DRAWN = DRAWN.add(_slot, "string")


class Sampler:
    """The choices of a configuration and a policy over the eligible patterns; a bounded table, sent to the executors once."""

    def __init__(self, config: dict, policy: dict, patterns: DataFrame):
        S.check_policy_domain(policy, config, patterns)
        self.config = config
        self.signatures: dict[tuple, dict[str, float]] = {}
        for e in policy["signature_entries"]:
            self.signatures.setdefault((e["semantic_family"], str(e["complexity_bucket"])), {})["+".join(e["atom_kinds"])] = float(e["weight"])
        entries = S.policy_table(patterns.sparkSession, policy).select("family", "bucket", "signature")
        rows = P.eligible(patterns).withColumn("signature", F.array_join(P.signature(), "+")).join(F.broadcast(entries), ["family", "bucket", "signature"])
        self.completions: dict[tuple, list[dict]] = {}
        for r in rows.orderBy("pos").collect():  # the space has 32,768 patterns
            self.completions.setdefault((r.family, r.bucket, r.signature), []).append({s: r[s] for s in P.SLOTS} | {"pos": r.pos, "n": r.n})

    def plan(self, rng: random.Random) -> tuple[str, str]:
        """Family and bucket, by one draw each; one in all where the family has no clauses."""
        families = list(P.FAMILIES)
        family = weighted(rng, families, [self.config["family_weights"][f] for f in families])
        buckets = [b for b in P.BUCKETS if b in P.FAMILIES[family]]
        if buckets == ["0"]:
            return family, "0"
        return family, weighted(rng, buckets, [self.config["constraint_count_weights"][b] for b in buckets])

    def signature(self, rng: random.Random, family: str, bucket: str) -> str:
        options = self.signatures[family, bucket]
        return draw(rng, list(options), list(options.values()))

    def mechanics(self, rng: random.Random, family: str, bucket: str, signature: str) -> dict:
        """A pattern of this signature: slot by slot, of what some pattern left still has, first the operator, then its cardinality, or the form of a range."""
        left = self.completions[family, bucket, signature]
        ranges = S.ranges(self.config)
        for slot in signature.split("+"):
            if slot in P.SET_SLOTS:
                has = {(o, int(c)) for o, c in (p[slot].split(":") for p in left)}
                operators = [o for o in Q.OPERATORS if any(o == x for x, _ in has)]
                o = draw(rng, operators, [self.config["operator_weights"][x] for x in operators])
                sizes = [c for c in S.CARDINALITIES[o] if (o, c) in has]
                c = draw(rng, sizes, [self.config["operator_cardinality"][o][x] for x in sizes])
                left = [p for p in left if p[slot] == f"{o}:{c}"]
            elif slot in P.RANGE_SLOTS:
                forms = [f for f in P.RANGE_OPTIONS if any(p[slot] == f for p in left)]
                form = draw(rng, forms, [ranges[slot][f] for f in forms])
                left = [p for p in left if p[slot] == form]
        (found,) = left
        return found

    def pattern(self, rng: random.Random) -> dict:
        family, bucket = self.plan(rng)
        signature = self.signature(rng, family, bucket)
        return self.mechanics(rng, family, bucket, signature) | {"family": family, "bucket": bucket, "signature": signature}


def operator_cardinality(rng: random.Random, config: dict, bucket: str) -> tuple[str, int]:
    """An operator and a cardinality whose clauses are just the bucket."""
    pairs = [(o, c) for o, sizes in S.CARDINALITIES.items() for c in sizes if str(1 if o == "any_of" else c) == bucket]
    if not pairs:
        raise S.SamplerError(f"no operator has {bucket} clauses")
    operators = list(dict.fromkeys(o for o, _ in pairs))
    o = draw(rng, operators, [config["operator_weights"][x] for x in operators])
    sizes = [c for x, c in pairs if x == o]
    return o, draw(rng, sizes, [config["operator_cardinality"][o][c] for c in sizes])


def drawn_patterns(rows: DataFrame, seed: str, sampler: Sampler, to: str = "pattern") -> DataFrame:
    """rows with the struct of a pattern, drawn by each row's seed."""

    @F.pandas_udf(DRAWN)
    def run(seeds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sampler.pattern(random.Random(int(s))) for s in seeds], columns=DRAWN.names)

    return spread(rows).withColumn(to, run(F.col(seed)))


def drawn_pairs(rows: DataFrame, seed: str, bucket: str, config: dict) -> DataFrame:
    """rows with operator and cardinality, drawn by each row's seed for its bucket."""

    @F.pandas_udf(T.StructType().add("operator", "string").add("cardinality", "integer"))
    def run(seeds: pd.Series, buckets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [operator_cardinality(random.Random(int(s)), config, b) for s, b in zip(seeds, buckets, strict=True)], columns=["operator", "cardinality"]
        )

    return spread(rows).withColumn("_d", run(F.col(seed), F.col(bucket))).select("*", "_d.*").drop("_d")
