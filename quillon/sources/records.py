"""Readers and writers of query datasets: evaluation inputs, predictions, training records, configurations."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import is_canonical_text, without_line_end
from quillon.operators import patterns
from quillon.plans import query as Q
from quillon.sources import lines
from quillon.sources.catalog import first_faults

INPUT = "sample_id string, challenge_id string, split string, user_text string, gold_query string, semantic_family string, constraint_count int, constraint_signature string, normalization_rule_ids array<string>"
# The columns of a prediction. Queries and mappings stay JSON texts.
PREDICTION = (
    "sample_id string, split string, user_text string, gold_query string, raw_model_output string, parsed_prediction string, parse_error string, schema_error string, "
    "domain_error string, canonical_prediction string, exact_match boolean, field_correctness map<string,boolean>, hard_constraint_tp long, hard_constraint_fp long, "
    "hard_constraint_fn long, error_labels array<string>, recoverable_json boolean, semantic_family string, constraint_count int, constraint_signature string, "
    "normalization_rule_ids array<string>, model_id string, tokenizer_id string, resolved_model_revision string, prompt_version string, serialization_identity string, "
    "generation_config string"
)
#: Columns of a prediction that hold a JSON value as it is.
NESTED = ("gold_query", "parsed_prediction", "canonical_prediction", "generation_config")


class RecordError(ValueError):
    """What a file of records has wrong."""


# --- documents of configuration, on the driver --------------------------------------------------------------------


def _no_repeats(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise RecordError("a key comes twice in one object")
    return found


def load_strict(text: str, keys: tuple[str, ...] | None = None, in_order: bool = False) -> dict:
    """One JSON object without repeated keys, with just these keys, in this order if asked for."""
    try:
        found = json.loads(text, object_pairs_hook=_no_repeats)
    except json.JSONDecodeError as e:
        raise RecordError(str(e)) from None
    if not isinstance(found, dict):
        raise RecordError("no JSON object")
    if keys is not None and (tuple(found) != keys if in_order else set(found) != set(keys)):
        raise RecordError(f"keys are {list(found)} and not {list(keys)}")
    return found


def load_rules(text: str) -> Q.Rules:
    """Domain rules of a JSON document: vocabularies, tag groups and numeric rules."""
    d = load_strict(text, ("rules_version", "schema_version", "executable_subset_version", "executable_subset_hash", "taxonomy", "tag_groups", "numeric_rules"))
    t = d["taxonomy"]
    names = ("genres", "tags", "formats", "statuses", "soft_preferences")
    if set(t) != set(names):
        raise RecordError("taxonomy has other keys")
    for n in names:
        if len({x.strip() for x in t[n]}) < len(t[n]) or any(not x.strip() for x in t[n]):
            raise RecordError(f"{n} has empty or repeated values")
    groups = {k: (tuple(g["tags"]), tuple(g["allowed_operators"]), g["normalization_rule_id"]) for k, g in d["tag_groups"].items()}
    bounds = {k: (r["minimum"], r["maximum"]) for k, r in d["numeric_rules"].items()}
    return Q.Rules(**{n: frozenset(x.strip() for x in t[n]) for n in names}, groups=groups, **bounds)


def load_frozen(text: str, kinds: dict[str, type | tuple[type, ...]], frozen: dict | None = None) -> dict:
    """A configuration with just these keys, values of these types (a truth value is no number), and these values where a contract fixes them."""
    found = load_strict(text, tuple(kinds))
    for k, kind in kinds.items():
        allowed = kind if isinstance(kind, tuple) else (kind,)
        if not isinstance(found[k], allowed) or isinstance(found[k], bool) and bool not in allowed:
            raise RecordError(f"{k} is no {'/'.join(t.__name__ for t in allowed)}: {found[k]!r}")
    if wrong := {k: found.get(k) for k, v in (frozen or {}).items() if found.get(k) != v}:
        raise RecordError(f"values differ from what is fixed: {wrong}")
    return found


def utc_timestamp(text: str) -> str:
    """An ISO 8601 time in UTC with a trailing Z, unchanged."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", text):
        raise RecordError(f"no UTC time: {text!r}")
    datetime.fromisoformat(text.replace("Z", "+00:00"))
    return text


def manifest(rows: int, versions: dict[str, str], hashes: dict[str, str], created: str) -> dict:
    return {"rows": rows, **versions, **hashes, "created_at": utc_timestamp(created)}


def write_new(path: str, text: str) -> None:
    """Creates a file; an existing one is an error."""
    with open(path, "x", encoding="utf-8", newline="\n") as f:
        f.write(text)


def write_bundle(files: dict[str, str]) -> None:
    """Creates several files, or none if one exists."""
    if found := [p for p in files if os.path.exists(p)]:
        raise FileExistsError(found[0])
    for p, text in files.items():
        write_new(p, text)


def write_pretty(path: str, value) -> None:
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def title_pool(text: str) -> list[str]:
    """The titles of a pool: unique, without outer white space, already sorted."""
    titles = load_strict(text, ("pool_version", "titles"))["titles"]
    if any(not isinstance(t, str) or not t or t != t.strip() for t in titles) or any(a >= b for a, b in zip(titles, titles[1:], strict=False)):
        raise RecordError("titles are not sorted, unique and trimmed")
    return titles


MANIFEST = ("manifest_version", "dataset_version", "cases")
CASE = ("case_id", "semantic_family", "complexity_bucket", "atoms", "generation_family", "template_id", "split", "seeds")
# The splits and families of text of a pilot, and how many records it may have.
PILOT_SPLITS, PILOT_TEXTS, PILOT_RECORDS = ("train", "validation", "test"), ("direct_explicit_v1", "direct_compact_v1", "natural_compact_v1"), (200, 300)


def _atom(raw) -> tuple[str, str]:
    """(slot, payload) of a slot as a manifest writes it."""
    kind = raw.get("kind") if isinstance(raw, dict) else None
    if kind not in patterns.SLOTS:
        raise RecordError(f"no slot: {raw!r}")
    keys = {"kind", "operator", "cardinality"} if kind in patterns.SET_SLOTS else {"kind", "range_pattern"} if kind in patterns.RANGE_SLOTS else {"kind"}
    if set(raw) != keys:
        raise RecordError(f"{kind} has wrong keys: {sorted(raw)}")
    payload = f"{raw['operator']}:{raw['cardinality']}" if kind in patterns.SET_SLOTS else raw.get("range_pattern", "used")
    if payload not in [p for p, _ in patterns.options(kind)]:
        raise RecordError(f"{kind} has no option {payload!r}")
    return kind, payload


def load_pilot(text: str) -> dict:
    """A pilot's manifest: cases in order of unique ids, each with a pattern that its family and bucket may have, a template of its own in one split, and ascending seeds."""
    manifest = load_strict(text, MANIFEST)
    cases, ids = manifest["cases"], []
    if not isinstance(cases, list) or not cases:
        raise RecordError("no cases")
    for c in cases:
        if not isinstance(c, dict) or set(c) != set(CASE):
            raise RecordError("a case has other keys")
        ids.append(c["case_id"])
        made = [_atom(a) for a in c["atoms"]]
        c["slots"] = dict.fromkeys(patterns.SLOTS) | dict(made)
        if [k for k, _ in made] != [s for s in patterns.SLOTS if c["slots"][s]]:
            raise RecordError(f"{c['case_id']}: slots are not in order, or come twice")
        c["n"] = patterns.clauses(c["slots"])
        if c["semantic_family"] not in patterns.families(c["slots"]) or str(c["complexity_bucket"]) != patterns.bucket_of(c["n"]):
            raise RecordError(f"{c['case_id']}: the pattern is not of its family and bucket")
        if c["generation_family"] not in PILOT_TEXTS or c["template_id"] != f"{c['case_id']}__{c['generation_family']}" or c["split"] not in PILOT_SPLITS:
            raise RecordError(f"{c['case_id']}: wrong text family, template or split")
        seeds = c["seeds"]
        if not seeds or any(type(s) is not int for s in seeds) or any(a >= b for a, b in zip(seeds, seeds[1:], strict=False)):
            raise RecordError(f"{c['case_id']}: seeds are none, or don't ascend")
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise RecordError("ids of cases are not in order, or come twice")
    if not PILOT_RECORDS[0] <= sum(len(c["seeds"]) for c in cases) <= PILOT_RECORDS[1]:
        raise RecordError("too few or too many records")
    return manifest


def pilot_cases(spark: SparkSession, manifest: dict) -> DataFrame:
    """A row for each case and seed: case_id, family, template_id, generation_family, split, the slots, n, seed."""
    rows = [
        (
            c["case_id"], c["semantic_family"], c["template_id"], c["generation_family"], c["split"], *[c["slots"][s] for s in patterns.SLOTS],
            c["n"], c["seeds"]
        ) for c in manifest["cases"]
    ]
    ddl = "case_id string, family string, template_id string, generation_family string, split string, " + ", ".join(f"{s} string" for s in patterns.SLOTS) + ", n int, seeds array<long>"
    return spark.createDataFrame(rows, ddl).withColumn("seed", F.explode("seeds")).drop("seeds")


# --- tables -------------------------------------------------------------------------------------------------------


def read_inputs(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Evaluation inputs of one split; a challenge's id is its sample id and its slice columns are null. gold_query stays JSON."""
    rows = spark.read.schema(INPUT).option("mode", "FAILFAST").json(path)
    return rows.withColumn("sample_id", F.coalesce("sample_id", "challenge_id")).withColumn("split", F.coalesce("split", F.lit(split))).drop("challenge_id")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All columns of predictions; a line that is no object of these types, or has no sample id, is an error."""
    rows = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)
    known = F.when(F.col("sample_id").isNotNull(), F.col("sample_id")).otherwise(F.raise_error(F.lit("a prediction has no sample id")).cast("string"))
    return rows.withColumn("sample_id", known)


def prediction_rows(evaluated: DataFrame, run: dict[str, str]) -> DataFrame:
    """Evaluated rows (sample_id, split, user_text, gold_query, raw_output, slice columns, e) as predictions; run has the identity of model, prompt and generation."""
    has = lambda c, t: F.col(c) if c in evaluated.columns else F.lit(None).cast(t)
    error = lambda before, here: F.when(before & ~here, F.col("e.error"))
    layers = [F.lit(True), F.col("e.parsed"), F.col("e.schema_ok"), F.col("e.domain_ok")]
    fields = F.create_map(*[x for f in Q.FIELDS for x in (F.lit(f), F.col(f"e.{f}_ok"))])
    made = {
        "sample_id": F.col("sample_id"), "split": has("split", "string"), "user_text": has("user_text", "string"), "gold_query": F.col("gold_query"), "raw_model_output": F.col("raw_output"),
        "parsed_prediction": F.when(F.col("e.parsed"), F.col("raw_output")), "parse_error": error(layers[0], layers[1]), "schema_error": error(layers[1], layers[2]), "domain_error": error(layers[2], layers[3]),
        "canonical_prediction": F.col("e.canonical"), "exact_match": F.col("e.exact"), "field_correctness": fields, "hard_constraint_tp": F.col("e.tp"), "hard_constraint_fp": F.col("e.fp"), "hard_constraint_fn": F.col("e.fn"),
        "error_labels": F.col("e.labels"), "recoverable_json": F.col("e.recoverable"), "semantic_family": has("semantic_family", "string"), "constraint_count": has("constraint_count", "int"),
        "constraint_signature": has("constraint_signature", "string"), "normalization_rule_ids": F.coalesce(
            has("normalization_rule_ids", "array<string>"), F.array().cast("array<string>")
        ),
        **{
            k: F.lit(run.get(k)).cast("string") for k in (
                "model_id", "tokenizer_id", "resolved_model_revision", "prompt_version", "serialization_identity", "generation_config"
            )
        },
    }
    return evaluated.select(*[c.alias(n) for n, c in made.items()])


def write_predictions(rows: DataFrame, path: str) -> None:
    """Predictions as JSON Lines in order of sample_id, keys sorted, nulls kept; fails if path exists.

    Columns that hold JSON are written as the values they are.
    """
    from quillon.functions.text import to_canonical_json

    names = sorted(rows.columns)
    parts = [
        F.concat(
            F.lit(f'"{n}":'),
            F.coalesce(F.col(n), F.lit("null")) if n in NESTED else F.regexp_extract(to_canonical_json(F.struct(F.col(n).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        ) for n in names
    ]
    lines = rows.select("sample_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))
    lines.orderBy("sample_id").select("value").write.mode("errorifexists").text(path)


@F.pandas_udf(T.StringType())
def _structure_fault(gold: pd.Series) -> pd.Series:
    def fault(text: str) -> str | None:
        try:
            Q.check_structure(json.loads(text))
            return None
        except (Q.QueryError, ValueError) as e:
            return str(e)

    return gold.map(fault, na_action="ignore")


def training_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, line, row, reason of the lines that can't be training records: no JSON object, sample_id or user_text no text or with outer white space, gold_query no query."""
    canonical = lambda f: lines.kind_of(f).eqNullSafe("STRING") & F.coalesce(is_canonical_text(lines.text_of(f)), F.lit(False))
    rules = {
        "sample_id is no text without outer white space": ~canonical("sample_id"), "gold_query is no object": lines.kind_of("gold_query") != "OBJECT",
        "user_text is no text without outer white space": ~canonical("user_text"),
    }
    every = lines.numbered(spark, path).where(F.trim("value") != "")
    wrong = lines.judged(every, rules, ["file", "line", "row"]).where("reason IS NOT NULL")
    rest = every.join(wrong.select("row"), "row", "left_anti").withColumn("reason", _structure_fault(F.get_json_object("value", "$.gold_query")))
    return wrong.unionAll(rest.where("reason IS NOT NULL").select("file", "line", "row", F.concat(F.lit("gold_query: "), "reason").alias("reason")))


def read_training(spark: SparkSession, path: str, split: str, rows: int, versions: dict[str, str]) -> DataFrame:
    """Training records: the exact number of rows, of these versions; test and challenge splits are refused."""
    if split not in ("train", "validation"):
        raise PermissionError(f"the {split} split is not for training")
    if wrong := first_faults(training_faults(spark, path)):
        raise RecordError(wrong)
    found = spark.read.schema(f"{INPUT}, " + ", ".join(f"{v} string" for v in versions)).option("mode", "FAILFAST").json(path)
    bad = F.lit(False)
    for name, want in versions.items():
        bad |= ~F.col(name).eqNullSafe(F.lit(want))
    s = found.agg(
        F.count("*").alias("n"), F.count_if(bad | ~F.coalesce(is_canonical_text(F.col("user_text")), F.lit(False))).alias("bad"),
        F.count_distinct("sample_id").alias("ids")
    ).first()
    if s.n != rows or s.bad or s.ids != s.n:
        raise RecordError(f"{s.n} rows ({rows} expected), {s.bad} of other versions or with untrimmed texts, {s.ids} ids")
    return found


def read_prompt(spark: SparkSession, path: str) -> Column | str:
    """A text file without its last line ends."""
    return spark.read.text(path, wholetext=True).select(without_line_end(F.col("value"))).first()[0]


def write_records(rows: DataFrame, path: str, order: str) -> None:
    """Compact JSON Lines with sorted keys in order of a column; fails if path exists."""
    from quillon.sources.catalog import _alphabetical
    from quillon.functions.text import to_canonical_json

    rows.select(
        F.col(order).alias("k"), to_canonical_json(_alphabetical(rows)).alias("value")
    ).orderBy("k").select("value").write.mode("errorifexists").text(path)


def markdown(title: str, tables: dict[str, list[tuple]]) -> str:
    """Frequency tables, each sorted, as a page."""
    out = [f"# {title}", ""]
    for name, rows in tables.items():
        out += [f"## {name}", "", "| value | count |", "| --- | ---: |", *(f"| {v} | {n} |" for v, n in sorted(rows, key=lambda r: str(r[0]))), ""]
    return "\n".join(out)


# --- a paged service ----------------------------------------------------------------------------------------------

# Answers after which a request is sent again, and how long it waits (in posted()).
RETRIED = (429, 500, 502, 503, 504)


def posted(send: Callable[[dict], tuple[int, dict, dict]], body: dict, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON answer of `send` (status, headers, answer), tried again after overload or loss of connection; waits grow, Retry-After counts, a minute at most."""
    for n in range(attempts):
        try:
            status, headers, answer = send(body)
        except (ConnectionError, TimeoutError):
            status, headers, answer = 503, {}, {}
        if status == 200:
            if answer.get("errors"):
                raise RuntimeError(f"the service reports {answer['errors']}")
            return answer
        if status not in RETRIED or n == attempts - 1:
            raise RuntimeError(f"the service answers {status}")
        sleep(min(60.0, max(3.0 * (n + 1), float(headers.get("Retry-After", 0)))))
    raise RuntimeError("no attempt")


def fetch_page(
    send: Callable[[dict], tuple[int, dict, dict]], variables: dict, page: int = 1, per_page: int = 50, timeout: float = 30.0, attempts: int = 4,
    sleep: Callable[[float], None] = time.sleep
) -> dict:
    """One page of media: {pageInfo, media}. What was asked for and what comes back are checked; every failure is a RuntimeError or ValueError."""
    if type(page) is not int or page < 1:
        raise ValueError("page must be 1 or more")
    if type(per_page) is not int or not 1 <= per_page <= 50:
        raise ValueError("per_page must be from 1 to 50")
    if not timeout > 0:
        raise ValueError("timeout must be above 0")
    answer = posted(send, {"variables": {**variables, "page": page, "perPage": per_page}, "timeout": timeout}, attempts, sleep)
    data = answer.get("data")
    found = data.get("Page") if isinstance(data, dict) else None
    info = found.get("pageInfo") if isinstance(found, dict) else None
    if not isinstance(info, dict) or type(info.get("hasNextPage")) is not bool or not isinstance(found.get("media"), list):
        raise RuntimeError("the answer is no page of media")
    if not all(isinstance(m, dict) for m in found["media"]):
        raise RuntimeError("a page has media that are no objects")
    return found


def crawl(
    send: Callable[[dict], tuple[int, dict, dict]], schedules: list[tuple[dict, int]], per_page: int = 50,
    sleep: Callable[[float], None] = time.sleep, timeout: float = 30.0
) -> Iterator[dict]:
    """Page records as read_pages() takes them, schedule by schedule until a page is the last or the schedule's pages are read."""
    if not 1 <= per_page <= 50:
        raise ValueError("per_page must be from 1 to 50")
    for k, (variables, most) in enumerate(schedules):
        for page in range(1, most + 1):
            found = fetch_page(send, variables, page, per_page, timeout, sleep=sleep)
            yield {"schedule": k, "page": page, "data": {"Page": found}}
            if not found["pageInfo"]["hasNextPage"]:
                break
