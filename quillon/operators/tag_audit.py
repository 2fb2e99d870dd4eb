"""Reviewed tags against the taxonomy they come from, the tags that may be used, and what rules say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans import query as Q


def audit_faults(audit: DataFrame, tags: DataFrame, snapshot_sha256: str) -> DataFrame:
    """(tag_id, tag_name, fault): a row for each thing that an audited tag has wrong.

    audit: tag_id, tag_name, category, approved, aliases, is_general_spoiler, is_adult, source_snapshot_hash; tags: id, name, category and the two flags of the
    snapshot. An audited tag is found by its id and by its name, which must be one tag of equal category and flags. Aliases are no tag's name, come
    once in their row, and once among approved rows. Ids and names come once.
    """
    facts = F.struct("id", "category", "is_general_spoiler", "is_adult")
    by_id = tags.select(F.col("id").alias("_id"), facts.alias("_of_id"))
    by_name = tags.select(F.col("name").alias("_name"), F.col("id").alias("_named"))
    rows = audit.join(by_id, F.col("tag_id") == F.col("_id"), "left").join(by_name, F.col("tag_name") == F.col("_name"), "left")
    known, named = F.col("_of_id").isNotNull(), F.col("_named").isNotNull()
    tests = {
        "another snapshot": ~F.col("source_snapshot_hash").eqNullSafe(F.lit(snapshot_sha256)),
        "unknown id": ~known, "unknown name": ~named, "id and name are two tags": known & named & (F.col("_of_id.id") != F.col("_named")),
        **{f"{c} differs": known & ~F.col(c).eqNullSafe(F.col(f"_of_id.{c}")) for c in ("category", "is_general_spoiler", "is_adult")},
        "an alias comes twice in a row": F.size(F.array_distinct("aliases")) < F.size("aliases"),
    }
    own = rows.select("tag_id", "tag_name", F.explode(F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull())).alias("fault"))
    aliases = audit.select("tag_id", "tag_name", "approved", F.explode(F.array_distinct("aliases")).alias("alias"))
    named_so = aliases.join(
        tags.select(F.col("name").alias("alias")).distinct(), "alias", "left_semi"
    ).select("tag_id", "tag_name", F.lit("an alias is a tag's name").alias("fault"))
    shared = aliases.where("approved").groupBy("alias").agg(F.collect_set(F.struct("tag_id", "tag_name")).alias("_of")).where("size(_of) > 1")
    shared = shared.select(F.explode("_of").alias("_t")).select("_t.tag_id", "_t.tag_name", F.lit("an alias is shared").alias("fault"))
    twice = [
        audit.groupBy(k).agg(F.count("*").alias("_n")).where("_n > 1").join(audit, k).select(
            "tag_id", "tag_name", F.lit(f"{k} comes twice").alias("fault")
        ) for k in ("tag_id", "tag_name")
    ]
    found = own
    for more in (named_so, shared, *twice):
        found = found.unionByName(more)
    return found.distinct()


def executable(audit: DataFrame) -> DataFrame:
    """The approved tags in order of id and name, with sorted aliases. An approved tag that is adult or a spoiler is an error, not left out."""
    wrong = F.when(F.col("is_adult"), "adult").when(F.col("is_general_spoiler"), "a spoiler")
    fault = F.concat(F.lit("the approved tag "), F.col("tag_name"), F.lit(" is "), wrong)
    sure = F.when(fault.isNull(), F.col("tag_id")).otherwise(F.raise_error(fault).cast("long"))
    approved = audit.where(F.coalesce("approved", F.lit(False)))
    return approved.select(
        sure.alias("tag_id"), "tag_name", "category", F.array_sort("aliases").alias("aliases"), "is_general_spoiler", "is_adult"
    ).orderBy("tag_id", "tag_name")


def target_faults(groups: DataFrame, active: DataFrame, approved: DataFrame) -> DataFrame:
    """(group, tag, fault): tags of groups (group, tag) that are not active (tag), and active tags that are not approved (tag)."""
    idle = groups.join(active.select("tag").distinct(), "tag", "left_anti").select("group", "tag", F.lit("not active").alias("fault"))
    unapproved = active.select("tag").distinct().join(approved.select("tag").distinct(), "tag", "left_anti")
    return idle.unionByName(unapproved.select(F.lit(None).cast("string").alias("group"), "tag", F.lit("not approved").alias("fault")))


def check_targets(rules: Q.Rules, executable_tags: DataFrame) -> None:
    """Raises QueryError unless the rules' groups have active tags only, and these are approved."""
    spark = executable_tags.sparkSession
    groups = spark.createDataFrame([(g, t) for g, (tags, _, _) in rules.groups.items() for t in tags], "group string, tag string")
    active = spark.createDataFrame([(t,) for t in sorted(rules.tags)], "tag string")
    found = target_faults(groups, active, executable_tags.select(F.col("tag_name").alias("tag"))).limit(5).collect()
    if found:
        raise Q.QueryError(f"tags of the rules don't fit: {[tuple(r) for r in found]}")
