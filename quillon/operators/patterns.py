"""The space of value-free query patterns and probability tables over it.

A pattern fills some of nine slots. It is one row: set slots hold operator and cardinality, range slots their form,
the other slots only whether they are there. The space is the product of the slots' options, so it is a
crossJoin of nine tables of at most eight rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Slots in canonical order, their options, families with the buckets each may have.
SET_SLOTS, RANGE_SLOTS = ("genre_set", "tag_set"), ("year_range", "episodes_range")
SLOTS = ("genre_set", "tag_set", "year_range", "episodes_range", "format_any", "status_any", "tag_group_any", "tag_group_none", "reference")
SET_OPTIONS = (("all_of", 1), ("all_of", 2), ("all_of", 3), ("any_of", 2), ("any_of", 3), ("none_of", 1), ("none_of", 2))
RANGE_OPTIONS = ("min_only", "max_only", "bounded_range")
BUCKETS = ("0", "1", "2", "3", "4", "5_plus")
FAMILIES = {
    "single_constraint": ("1",),
    "same_field_logic": ("1", "2", "3"),
    "cross_field_composition": ("2", "3", "4", "5_plus"),
    "normalization": ("1", "2", "3", "4", "5_plus"),
    "reference_only": ("0",),
    "reference_composition": ("1", "2", "3", "4", "5_plus"),
}
DIRECT = ("genre_set", "tag_set", "year_range", "episodes_range", "format_any", "status_any")


def options(slot: str) -> list[tuple[str | None, int]]:
    """(payload, clauses) of each option of a slot, the empty one first."""
    if slot in SET_SLOTS:
        return [(None, 0), *((f"{o}:{n}", 1 if o == "any_of" else n) for o, n in SET_OPTIONS)]
    if slot in RANGE_SLOTS:
        return [(None, 0), *((p, 2 if p == "bounded_range" else 1) for p in RANGE_OPTIONS)]
    return [(None, 0), ("used", 0 if slot == "reference" else 1)]


def clauses(slots: dict[str, str | None]) -> int:
    """The clauses of one filling."""
    n = sum(dict(options(s))[slots[s]] for s in SLOTS)
    return n - bool((slots["tag_set"] or "").startswith("any_of") and slots["tag_group_any"])  # a direct and a group ANY of tags are one


def bucket_of(n: int) -> str:
    return "5_plus" if n >= 5 else str(n)


def families(slots: dict[str, str | None]) -> list[str]:
    """The families that one filling is eligible for, whatever its bucket."""
    used, n = {s for s in SLOTS if slots[s]}, clauses(slots)
    groups, direct = used & {"tag_group_any", "tag_group_none"}, used & set(DIRECT)
    plain = not groups and "reference" not in used
    tests = {
        "single_constraint": plain and len(direct) == 1 and n == 1, "same_field_logic": len(used) == 1 and bool(used & set(SET_SLOTS)), "cross_field_composition": plain and len(direct) >= 2,
        "normalization": bool(groups), "reference_only": used == {"reference"}, "reference_composition": "reference" in used and not groups and bool(direct),
    }
    return [f for f, fits in tests.items() if fits and bucket_of(n) in FAMILIES[f]]


def plan_faults(plans: DataFrame) -> DataFrame:
    """plans (family, bucket, signature, slots, n) with `fault`, where a slot has no such option, or count, bucket, signature or family are not those of the slots."""
    wrong = reduce(Column.__or__, [~F.coalesce(F.col(s).isin(*[p for p, _ in options(s) if p]), F.lit(True)) for s in SLOTS])
    worth = {s: F.create_map(*[F.lit(x) for p, c in options(s) if p for x in (p, c)]) for s in SLOTS}
    merged = F.coalesce((F.col("tag_set").startswith("any_of") & F.col("tag_group_any").isNotNull()).cast("int"), F.lit(0))
    n = reduce(Column.__add__, [F.coalesce(worth[s][F.col(s)], F.lit(0)) for s in SLOTS]) - merged
    rules = family_rules()
    fits = reduce(Column.__or__, [(F.col("family") == f) & rules[f] & F.col("bucket").isin(*FAMILIES[f]) for f in FAMILIES])
    fault = (
        F.when(wrong, "no such option").when(~n.eqNullSafe(F.col("n")), "another clause count").when(
            ~F.col("bucket").eqNullSafe(bucket(F.col("n"))), "another bucket"
        )
        .when(
            ~F.col("signature").eqNullSafe(F.array_join(signature(), "+")), "another signature"
        ).when(~F.coalesce(fits, F.lit(False)), "the family can't have it")
    )
    return plans.withColumn("fault", fault).where("fault IS NOT NULL")


def space(spark: SparkSession) -> DataFrame:
    """All 32,768 fillings: a column for each slot, a place pos, and the clause count n."""
    made = None
    for slot in SLOTS:
        t = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(options(slot))], f"i_{slot} int, {slot} string, c_{slot} int")
        made = t if made is None else made.crossJoin(F.broadcast(t))  # eight rows at most
    # a direct and a group ANY of tags are one clause
    merged = (F.col("tag_set").startswith("any_of") & F.col("tag_group_any").isNotNull()).cast("int")
    n = reduce(Column.__add__, [F.col(f"c_{s}") for s in SLOTS]) - F.coalesce(merged, F.lit(0))
    pos = reduce(lambda a, s: a * len(options(s)) + F.col(f"i_{s}"), SLOTS, F.lit(0))
    return made.select(pos.alias("pos"), *SLOTS, n.alias("n"))


def bucket(n: Column) -> Column:
    return F.when(n >= 5, "5_plus").otherwise(n.cast("string"))


def family_rules() -> dict[str, Column]:
    used = {s: F.col(s).isNotNull() for s in SLOTS}
    count = lambda slots: reduce(Column.__add__, [used[s].cast("int") for s in slots])
    group, direct, atoms = used["tag_group_any"] | used["tag_group_none"], count(DIRECT), count(SLOTS)
    plain = ~group & ~used["reference"]
    return {
        "single_constraint": plain & (direct == 1) & (F.col("n") == 1),
        "same_field_logic": (atoms == 1) & (used["genre_set"] | used["tag_set"]),
        "cross_field_composition": plain & (direct >= 2),
        "normalization": group,
        "reference_only": used["reference"] & (atoms == 1),
        "reference_composition": used["reference"] & ~group & (direct >= 1),
    }


def eligible(patterns: DataFrame) -> DataFrame:
    """A row for each family and bucket that a pattern is eligible for."""
    fits = F.array(*[F.when(rule & bucket(F.col("n")).isin(*FAMILIES[f]), f) for f, rule in family_rules().items()])
    return patterns.withColumn("bucket", bucket(F.col("n"))).withColumn("family", F.explode(F.filter(fits, lambda f: f.isNotNull())))


def signature() -> Column:
    """The used slots, in order."""
    return F.filter(F.array(*[F.when(F.col(s).isNotNull(), s) for s in SLOTS]), lambda s: s.isNotNull())


def signatures(patterns: DataFrame) -> DataFrame:
    """family, bucket, signature, patterns: distinct signatures of eligible patterns."""
    return eligible(patterns).groupBy("family", "bucket", F.array_join(signature(), "+").alias("signature")).agg(F.count("*").alias("patterns"))


def normalised(weight: Column, *context: str) -> Column:
    """weight as a share of its context."""
    return weight / F.sum(weight).over(Window.partitionBy(*context))


def weights(spark: SparkSession, name: str, table: dict) -> DataFrame:
    return spark.createDataFrame([(str(k), float(v)) for k, v in table.items()], f"{name} string, w_{name} double")


def family_bucket_probabilities(spark: SparkSession, families: dict, buckets: dict) -> DataFrame:
    """P(family), P(bucket | family) over compatible buckets, and joint. A family without clauses has bucket 0 for sure."""
    pairs = spark.createDataFrame([(f, b) for f, bs in FAMILIES.items() for b in bs], "family string, bucket string")
    f = weights(spark, "family", families).withColumn("p_family", F.col("w_family") / F.sum("w_family").over(Window.partitionBy(F.lit(0))))
    rows = pairs.join(F.broadcast(f), "family").join(
        F.broadcast(weights(spark, "bucket", buckets)), "bucket", "left"
    ).withColumn("w", F.coalesce("w_bucket", F.lit(1.0)))
    return rows.withColumn("p_bucket", normalised(F.col("w"), "family")).select(
        "family", "bucket", "p_family", "p_bucket", (F.col("p_family") * F.col("p_bucket")).alias("joint")
    )


def marginal(joint: DataFrame, key: str) -> DataFrame:
    return joint.groupBy(key).agg(F.sum("joint").alias("p"))


def operator_probabilities(spark: SparkSession, operators: dict, cardinalities: dict[str, dict], at: str) -> DataFrame:
    """Operators and cardinalities whose clauses are just the bucket, by conditional weights: operator, cardinality, p_operator, p_cardinality, joint."""
    pairs = spark.createDataFrame(
        [(o, int(c), float(w), 1 if o == "any_of" else int(c)) for o, t in cardinalities.items() for c, w in t.items()],
        "operator string, cardinality int, w double, clauses int"
    )
    rows = pairs.where(bucket(F.col("clauses")) == at).join(F.broadcast(weights(spark, "operator", operators)), "operator")
    share = F.col("w_operator") / F.count("*").over(Window.partitionBy("operator"))
    rows = rows.withColumn(
        "p_operator", F.col("w_operator") / F.sum(share).over(Window.partitionBy(F.lit(0)))
    ).withColumn("p_cardinality", normalised(F.col("w"), "operator"))
    return rows.select("operator", "cardinality", "p_operator", "p_cardinality", (F.col("p_operator") * F.col("p_cardinality")).alias("joint"))


def mechanics(patterns: DataFrame, operators: dict, cardinalities: dict[str, dict], ranges: dict[str, dict]) -> DataFrame:
    """Eligible patterns with p, the probability of each within its family, bucket and signature.

    Slots are decided in order. At each, the options that some surviving pattern has are weighed (an operator, then its cardinality);
    how many patterns survive an option plays no part. A level is one window over what was decided before.
    """
    rows = eligible(patterns).withColumn("signature", F.array_join(signature(), "+")).withColumn("p", F.lit(1.0))
    context = ["family", "bucket", "signature"]

    def level(rows: DataFrame, option: str, weight: Column) -> DataFrame:
        # each distinct option counts once: its weight is shared by the rows that have it
        alike = F.count("*").over(Window.partitionBy(*context, option))
        rows = rows.withColumn("_w", weight).withColumn("_share", F.col("_w") / alike)
        total = F.sum("_share").over(Window.partitionBy(*context))
        return rows.withColumn("p", F.when(F.col(option).isNull(), F.col("p")).otherwise(F.col("p") * F.col("_w") / total)).drop("_w", "_share")

    table = lambda t: F.create_map(*[F.lit(x) for k, v in t.items() for x in (str(k), float(v))])
    for slot in (s for s in SLOTS if s in SET_SLOTS or s in RANGE_SLOTS):
        if slot in SET_SLOTS:
            rows = rows.withColumn(f"o_{slot}", F.split_part(F.col(slot), F.lit(":"), F.lit(1)))
            rows = level(rows, f"o_{slot}", F.coalesce(table(operators)[F.col(f"o_{slot}")], F.lit(1.0)))
            context.append(f"o_{slot}")
            rows = level(rows, slot, F.coalesce(table({f"{o}:{c}": w for o, t in cardinalities.items() for c, w in t.items()})[F.col(slot)], F.lit(1.0)))
        else:
            rows = level(rows, slot, F.coalesce(table(ranges[slot])[F.col(slot)], F.lit(1.0)))
        context.append(slot)
    return rows.drop(*[f"o_{s}" for s in SET_SLOTS])


def bindable(patterns: DataFrame, capacity: dict[str, int]) -> DataFrame:
    """Patterns whose set slots ask for no more values than there are, and whose other slots have any (capacity by slot)."""
    need = {
        s: F.coalesce(F.split_part(F.col(s), F.lit(":"), F.lit(2)).cast("int"), F.lit(0)) if s in SET_SLOTS else F.col(s).isNotNull().cast("int") for s in SLOTS
    }
    return patterns.where(reduce(Column.__and__, [need[s] <= capacity.get(s, 0) for s in SLOTS]))


def group_bindings(groups: DataFrame, vocabulary: int, reserve: int) -> DataFrame:
    """Pairs of an ANY and a NONE group that support it, are two, share no tag, and leave `reserve` direct tags of the vocabulary.

    groups (name, operators, tags) is a rule table of a handful of rows.
    """
    a = groups.where(F.array_contains("operators", "any_of")).select(F.col("name").alias("any_group"), F.col("tags").alias("_a"))
    b = groups.where(F.array_contains("operators", "none_of")).select(F.col("name").alias("none_group"), F.col("tags").alias("_b"))
    free = vocabulary - F.size(F.array_union("_a", "_b"))
    return a.join(
        F.broadcast(b), (F.col("any_group") != F.col("none_group")) & ~F.arrays_overlap("_a", "_b") & (free >= reserve)
    ).select("any_group", "none_group", free.alias("free_tags"))
