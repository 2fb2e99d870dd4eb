"""Evaluation of parsers against gold queries: layers, clauses, metrics, slices, comparisons."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import parse_strictly, recoverable
from quillon.plans import query as Q

# Error labels, in the order in which they are reported.
ERRORS = (
    "JSON_PARSE_ERROR", "SCHEMA_ERROR", "DOMAIN_ERROR", "MISSING_CONSTRAINT", "HALLUCINATED_CONSTRAINT", "WRONG_OPERATOR", "WRONG_VALUE",
    "WRONG_NUMERIC_BOUND", "REFERENCE_ERROR", "NORMALIZATION_ERROR"
)

FLAGS = ("parsed", "recoverable", "schema_ok", "domain_ok", "exact", *(f"{f}_ok" for f in Q.FIELDS))


def _schema() -> T.StructType:
    s = T.StructType()
    for f in FLAGS:
        s = s.add(f, "boolean")
    for n in ("tp", "fp", "fn"):
        s = s.add(n, "long")
    return s.add("labels", T.ArrayType(T.StringType())).add("canonical", "string").add("error", "string")


def _value(q: dict, field: str):
    return q["hard_constraints"][field] if field in Q.HARD else q[field]


def _labels(gold: dict, got: dict, right: dict[str, bool], fp: int, fn: int, normalised: bool) -> list[str]:
    def moved(f: str) -> bool:
        a, b = gold["hard_constraints"][f], got["hard_constraints"][f]
        return any(o != p and set(a[o]) & set(b[p]) for o in Q.OPERATORS for p in Q.OPERATORS)

    def filled(x) -> bool:
        return bool(x) if isinstance(x, list) else any(x.values())

    tests = {
        "MISSING_CONSTRAINT": fn > 0,
        "HALLUCINATED_CONSTRAINT": fp > 0,
        "WRONG_OPERATOR": any(map(moved, Q.SETS)),
        "WRONG_VALUE": any(not right[f] and filled(_value(gold, f)) and filled(_value(got, f)) for f in (*Q.SETS, *Q.LISTS)),
        "WRONG_NUMERIC_BOUND": not (right["year"] and right["episodes"]),
        "REFERENCE_ERROR": not right["reference_titles"],
        "NORMALIZATION_ERROR": normalised and not right["tags"],
    }
    return [e for e in ERRORS if tests.get(e)]


def evaluate(raw: str, gold_json: str, rules: Q.Rules, normalised: bool = False) -> dict:
    """One raw output against its gold query: the first layer that fails ends it, and then nothing counts as right."""
    gold = Q.canonical(json.loads(gold_json))
    out = dict.fromkeys(FLAGS, False) | {"recoverable": recoverable(raw), "labels": [], "canonical": None, "error": None}
    got, out["error"] = parse_strictly(raw)
    layer = "JSON_PARSE_ERROR"
    if got is not None:
        out["parsed"] = True
        try:
            layer = "SCHEMA_ERROR"
            Q.check_structure(got)
            out["schema_ok"] = True
            layer = "DOMAIN_ERROR"
            Q.check_domain(got, rules)
            out["domain_ok"] = True
        except Q.QueryError as e:
            out["error"] = str(e)
    wanted = set(Q.clauses(gold))
    if out["domain_ok"]:
        got = Q.canonical(got)
        right = {f: _value(got, f) == _value(gold, f) for f in Q.FIELDS}
        found = set(Q.clauses(got))
        out |= {f"{f}_ok": ok for f, ok in right.items()} | {"exact": got == gold, "canonical": Q.dumps(got)}
        out |= {"tp": len(wanted & found), "fp": len(found - wanted), "fn": len(wanted - found)}
        out["labels"] = _labels(gold, got, right, out["fp"], out["fn"], normalised)
    else:
        out |= {"tp": 0, "fp": 0, "fn": len(wanted), "labels": [layer]}
    return out


def evaluated(predictions: DataFrame, rules: Q.Rules, raw: str = "raw_output", gold: str = "gold_query", normalised: str | None = None) -> DataFrame:
    """predictions with the struct `e` of evaluate(); gold is canonical JSON. Null outputs count as empty ones.

    Python, because the key sets and types of untrusted JSON are lost once a schema is applied to it. Equal outputs to
    equal gold queries are judged once a batch.
    """
    schema = _schema()

    @F.pandas_udf(schema)
    def run(raws: pd.Series, golds: pd.Series, flags: pd.Series) -> pd.DataFrame:
        keys = [(r or "", g, bool(n)) for r, g, n in zip(raws, golds, flags, strict=True)]
        place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        judged = pd.DataFrame([evaluate(r, g, rules, n) for r, g, n in place], columns=schema.names)
        return judged.iloc[[place[k] for k in keys]].reset_index(drop=True)

    return predictions.withColumn("e", run(F.col(raw), F.col(gold), F.col(normalised) if normalised else F.lit(False)))


def clause_counts(gold: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn of two arrays of clauses taken as sets; null counts as none."""
    g, p = (F.coalesce(c, F.array().cast("array<string>")) for c in (gold, predicted))
    return [
        F.size(F.array_intersect(g, p)).cast("long").alias("tp"), F.size(F.array_except(p, g)).cast("long").alias("fp"),
        F.size(F.array_except(g, p)).cast("long").alias("fn")
    ]


def ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b, or `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def measures(flags: tuple[str, ...] = ()) -> list[Column]:
    """Aggregates of rows with tp, fp, fn and boolean flags: total, a rate for each flag, micro precision, recall, F1."""
    tp, fp, fn = (F.sum(n) for n in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
    rates = [F.avg(F.col(f).cast("int")).alias(f"{f.replace('.', '_')}_rate") for f in flags]
    return [
        F.count("*").alias("total"), *rates, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"),
        ratio(2 * p * r, p + r, 0.0).alias("f1")
    ]


def metrics(rows: DataFrame, flags: tuple[str, ...] = ()) -> DataFrame:
    return rows.agg(*measures(flags))


def slices(rows: DataFrame, by: list[str], flags: tuple[str, ...] = ()) -> DataFrame:
    """The metrics of all rows and of each value of each column in `by`, in one aggregation: slice, value, measures.

    Null values make no slice. Grouping sets expand a row len(by) + 1 times before the partial aggregation.
    """
    keyed = rows.withColumn(
        "_s",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("slice"), v.alias("value")) for n, v in [("overall", F.lit("all")), *[(b, F.col(b).cast("string")) for b in by]]])
        )
    )
    return keyed.where("_s.value IS NOT NULL").groupBy("_s.slice", "_s.value").agg(*measures(flags))


def label_counts(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """The count of each error label, zero for those that no row has."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, e) for i, e in enumerate(ERRORS)], "pos int, label string")
    counted = rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counted, "label", "left").select("pos", "label", F.coalesce("n", F.lit(0)).alias("n"))


def paired(base: DataFrame, tuned: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Both runs' rows side by side by keys, with `fault` where a row has no partner or the identity columns differ."""
    b, t = base.select([F.col(c).alias(f"b_{c}") for c in base.columns]), tuned.select([F.col(c).alias(f"t_{c}") for c in tuned.columns])
    on = reduce(Column.__and__, [F.col(f"b_{k}").eqNullSafe(F.col(f"t_{k}")) for k in keys])
    same = reduce(Column.__and__, [F.col(f"b_{c}").eqNullSafe(F.col(f"t_{c}")) for c in identity], F.lit(True))
    fault = F.when(F.col(f"t_{keys[0]}").isNull(), "not in tuned").when(F.col(f"b_{keys[0]}").isNull(), "not in base").when(~same, "identity differs")
    return b.join(t, on, "full").withColumn("fault", fault)


def zipped(base: DataFrame, tuned: DataFrame, identity: list[str], position: str = "row") -> DataFrame:
    """Both runs' rows side by side by position, with `faults`: the identity columns that differ. Other numbers of rows, or a position twice, are an error.

    Positions are numbers that sources.lines gives; each side is one shuffle by position, which no row shares.
    """
    def sides(df: DataFrame, letter: str) -> DataFrame:
        return df.select(F.col(position).alias(f"{letter}_row"), *[F.col(c).alias(f"{letter}_{c}") for c in df.columns if c != position])

    counts = [df.agg(F.count("*").alias("n"), F.coalesce(F.max(position), F.lit(0)).alias("last"), F.count_distinct(position).alias("places")).first() for df in (base, tuned)]
    for n, last, places in counts:
        if n != last or n != places:
            raise ValueError(f"{n} rows have {places} positions, the last of which is {last}")
    if counts[0].n != counts[1].n:
        raise ValueError(f"{counts[0].n} rows of one run and {counts[1].n} of the other")
    wrong = [F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"t_{c}")), c) for c in identity]
    listed = F.filter(F.array(*wrong), lambda x: x.isNotNull()) if identity else F.array().cast("array<string>")
    pairs = sides(base, "b").join(sides(tuned, "t"), F.col("b_row") == F.col("t_row"))
    return pairs.withColumn("faults", listed).withColumnRenamed("b_row", position).drop("t_row")


def transition(before: Column, after: Column) -> Column:
    return F.when(before & after, "kept").when(~before & after, "fixed").when(before & ~after, "regressed").otherwise("still_failed")


def transitions(pairs: DataFrame, by: list[str], before: Column, after: Column) -> DataFrame:
    return pairs.groupBy(*by, transition(before, after).alias("transition")).agg(F.count("*").alias("n"))


def folded_singletons(q: dict) -> dict:
    """The canonical query with a lone ANY value moved to ALL, for a comparison that takes both as the same."""
    q = Q.canonical(q)
    for f in Q.SETS:
        c = q["hard_constraints"][f]
        if len(c["any_of"]) == 1:
            c["all_of"], c["any_of"] = sorted([*c["all_of"], *c["any_of"]]), []
    return q


def fidelity(cases: DataFrame) -> DataFrame:
    """cases (status, parsed and expected queries as canonical JSON, result_ids, allowed_ids) with exact, semantic and violations.

    semantic takes a lone ANY value for ALL; violations are results that the expected query does not allow. A null parsed query equals none.
    """

    @F.pandas_udf("boolean")
    def alike(parsed: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series(
            [p is not None and folded_singletons(json.loads(p)) == folded_singletons(json.loads(e)) for p, e in zip(parsed, expected, strict=True)],
            dtype=bool
        )

    none = F.array().cast(cases.schema["result_ids"].dataType)
    return cases.withColumns({
        "exact": F.coalesce(F.col("parsed") == F.col("expected"), F.lit(False)), "semantic": alike("parsed", "expected"),
        "violations": F.array_except(F.coalesce("result_ids", none), F.coalesce("allowed_ids", none)),
    })


def fidelity_counts(judged: DataFrame) -> DataFrame:
    """One row: ok, exact, semantic and all cases, and results against what was meant."""
    return judged.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if("exact").alias("exact"), F.count_if("semantic").alias("semantic"), F.count("*").alias("cases"),
        F.coalesce(F.sum(F.size("violations")), F.lit(0)).cast("long").alias("violating_results"),
    )


def authorised(split: str, frozen: bool) -> None:
    """Test and challenge splits only once the prompt is frozen."""
    if split in ("test", "challenge") and not frozen:
        raise PermissionError(f"the {split} split needs a frozen prompt")
