"""From a service's taxonomy and a catalog to the domain that queries may use, and cases that people wrote for it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import audit, search, tag_audit
from quillon.plans import query as Q
from quillon.plans import sampler as S
from quillon.sources import records as R
from quillon.sources import taxonomy as T


def audit_of(snapshot: dict, allowed: dict[str, list[str]], reason: str = "on the list of allowed tags") -> list[dict]:
    """A review of every tag: approved are those of `allowed` (name -> aliases); a name that the snapshot lacks is an error."""
    if missing := sorted(set(allowed) - {t["name"] for t in snapshot["tags"]}):
        raise R.RecordError(f"the snapshot lacks {missing}")
    sha = T.sha256(T.dumps_snapshot(snapshot))
    return [
        {
            "tag_id": t["id"], "tag_name": t["name"], "category": t["category"], "approved": t["name"] in allowed, "reason": reason if t["name"] in allowed else f"not {reason}",
            "aliases": sorted(allowed.get(t["name"], [])), "is_general_spoiler": t["is_general_spoiler"], "is_adult": t["is_adult"], "source_snapshot_hash": sha,
        }
        for t in snapshot["tags"]
    ]


def real_domain(
    spark: SparkSession, payload: dict, allowed: dict[str, list[str]], catalog: DataFrame, config: dict, formats: list[str], statuses: list[str],
    groups: dict, year: tuple[int, int], version: str, titles: int = 200
) -> dict:
    """snapshot, audit, subset, rules, titles and configuration of a domain, each checked against the others.

    Tags are active if they are approved and some row of the catalog has them with a relevant rank. Only vocabularies and `titles` titles come to the driver.
    """
    snapshot = T.snapshot_of(payload)
    rows = audit_of(snapshot, allowed)
    reviewed = T.audit_table(spark, rows)
    if found := tag_audit.audit_faults(reviewed, T.tags_table(spark, snapshot), T.sha256(T.dumps_snapshot(snapshot))).limit(5).collect():
        raise R.RecordError(f"the audit doesn't fit: {[tuple(r) for r in found]}")
    executable = tag_audit.executable(reviewed)
    subset = T.subset_document(executable, version, T.sha256(T.dumps_snapshot(snapshot)))
    used = audit.tag_frequency(catalog).join(F.broadcast(executable.select(F.col("tag_name").alias("tag"))), "tag", "left_semi")  # a vocabulary
    active = {r.tag for r in used.collect()} | {t for tags, _, _ in groups.values() for t in tags}
    rules = Q.Rules(
        genres=frozenset(snapshot["genres"]), tags=frozenset(active), formats=frozenset(formats), statuses=frozenset(statuses), groups=groups,
        year=year
    )
    tag_audit.check_targets(rules, executable)
    S.check_config_domain(config, rules)
    pool = sorted({r.title for r in search.popular_pool(catalog, titles).collect() if r.title})
    R.title_pool(json.dumps({"pool_version": version, "titles": pool}))
    return {"snapshot": snapshot, "audit": rows, "subset": subset, "rules": rules, "titles": pool, "config": config}


def authored_cases(spark: SparkSession, cases: list[tuple[str, str, dict]], rules: Q.Rules) -> DataFrame:
    """Cases (id, text, spec) that people wrote: challenge_id, user_text, gold_query, signature, clauses. A repeated id or text, or a spec outside the rules, is an error."""
    for place, what in ((0, "id"), (1, "text")):
        if len({c[place].strip() for c in cases}) < len(cases) or any(not c[place].strip() for c in cases):
            raise R.RecordError(f"a case's {what} is empty or comes twice")
    made = []
    for i, text, spec in cases:
        gold = Q.build(spec, rules)
        made.append((i, text, Q.dumps(gold), Q.signature(gold), Q.count_clauses(spec)))
    return spark.createDataFrame(made, "challenge_id string, user_text string, gold_query string, signature string, clauses long")
