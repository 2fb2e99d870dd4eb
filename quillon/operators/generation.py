"""Queries drawn from patterns: values bound by seed, gold query, text, identity, and datasets without used texts."""

from __future__ import annotations

import json
import random
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import canonical_json, sha256, to_canonical_json
from quillon.operators.patterns import SLOTS
from quillon.operators.samplers import Sampler
from quillon.operators.sampling import draw, draw_without, realised, spread
from quillon.plans import query as Q
from quillon.plans import sampler as S

#: How each constraint reads, by field and operator.
TEMPLATES = {
    "genres.all_of": "all of the genres {values}", "genres.any_of": "any of the genres {values}", "genres.none_of": "none of the genres {values}",
    "tags.all_of": "all of the themes {values}", "tags.any_of": "any of the themes {values}", "tags.none_of": "none of the themes {values}",
    "year.min": "from {values} on", "year.max": "until {values}", "episodes.min": "at least {values} episodes", "episodes.max": "at most {values} episodes",
    "formats": "as {values}", "status": "with status {values}", "reference_titles": "like {values}",
}

#: Wordings of a dataset's texts, by language: openings, and how a constraint reads by its part of a slot, and a field is called.
WORDINGS = {
    "en": {
        "openings": ("Show me titles with", "I would watch something with", "Search:"), "and": " and ", "or": " or ",
        "parts": {"all_of": "{noun} {all}", "any_of": "{noun} {any}", "none_of": "no {noun} {any}", "min": "{noun} {any} or more", "max": "{noun} {any} or less", None: "{noun} {any}"},
        "nouns": {"genres": "genre", "tags": "theme", "groups": "kind", "year": "year", "episodes": "episode count", "formats": "format", "status": "status", "reference_titles": "likeness to"},
    },
    "de": {
        "openings": ("Gesucht wird etwas mit", "Bitte Titel mit"), "and": " und ", "or": " oder ",
        "parts": {"all_of": "{noun} {all}", "any_of": "{noun} {any}", "none_of": "ohne {noun} {any}", "min": "{noun} ab {any}", "max": "{noun} bis {any}", None: "{noun} {any}"},
        "nouns": {"genres": "Genre", "tags": "Thema", "groups": "Art", "year": "Jahr", "episodes": "Folgenzahl", "formats": "Format", "status": "Status", "reference_titles": "Nähe zu"},
    },
}
SEPARATORS = (", ", "; ", " / ")
#: A style is a language with one of its openings, and a separator of clauses.
STYLES = tuple((name, opening, separator) for name, w in WORDINGS.items() for opening in w["openings"] for separator in SEPARATORS)
TWO_VALUES, OTHER_NAMES = 0.2, 0.75
#: Attempts for each record that is wanted.
TRIES = 20


class Pools:
    """What values may be drawn from: weights of genres and tags, numbers, titles.

    Numbers are a list, each as likely as the others, or (weight, numbers) of several pools.
    """

    def __init__(self, genres: dict[str, float], tags: dict[str, float], years: list, episodes: list, titles: list[str]):
        self.genres, self.tags, self.titles = genres, tags, titles
        self.years, self.episodes = ([(w, sorted(v)) for w, v in (x if x and isinstance(x[0], tuple) else [(1.0, x)])] for x in (years, episodes))

    @classmethod
    def of(cls, config: dict, rules: Q.Rules, titles: list[str]) -> Pools:
        """The pools of a sampling configuration over the rules' values."""
        S.check_config_domain(config, rules)
        for field in ("genres", "tags"):
            S.check_shares(config, field, getattr(rules, field))
        return cls(
            S.value_weights(config, "genres", rules.genres), S.value_weights(config, "tags", rules.tags), S.number_pools(config, "year"),
            S.number_pools(config, "episodes"), titles
        )


def group_pairs(pattern: dict, rules: Q.Rules) -> list[tuple[str | None, str | None]]:
    """(ANY group, NONE group) that fit the pattern: each stands under its operator, they are two, share no tag, and leave enough direct tags."""
    need = int(pattern["tag_set"].split(":")[1]) if pattern["tag_set"] else 0
    options = [
        sorted(g for g, (_, ops, _) in rules.groups.items() if o in ops) if pattern[slot] else [None] for slot,
        o in (("tag_group_any", "any_of"), ("tag_group_none", "none_of"))
    ]
    tags = {g: frozenset(t) for g, (t, _, _) in rules.groups.items()} | {None: frozenset()}
    return [(a, b) for a, b in product(*options) if (a is None or a != b) and not tags[a] & tags[b] and len(rules.tags - tags[a] - tags[b]) >= need]


def _bounds(kind: str, pools: list[tuple[float, list[int]]], rng: random.Random) -> dict:
    """A pool, then a number of it; an upper bound by the chances of all numbers from the lower one on."""
    weight, numbers = draw(rng, pools, [w for w, _ in pools])
    first = draw(rng, numbers, [1.0] * len(numbers))
    if kind != "bounded_range":
        return {"min": first if kind == "min_only" else None, "max": first if kind == "max_only" else None}
    total = sum(w for w, _ in pools)
    chances = sorted((v, w / total / len(vs)) for w, vs in pools for v in vs)
    above = [(v, p) for v, p in chances if v >= first]
    return {"min": first, "max": draw(rng, [v for v, _ in above], [p for _, p in above])}


def bind(pattern: dict, seed: int | random.Random, rules: Q.Rules, pools: Pools) -> dict:
    """A spec of the pattern with values drawn by random.Random(seed), or by the generator given.

    A pair of groups that fits comes first, each as likely as the others; its tags are then out of reach of direct tags. Genres, tags,
    numbers, lists and the reference follow. The clauses of the spec are those of the pattern.
    """
    rng, spec = seed if isinstance(seed, random.Random) else random.Random(seed), Q.empty()
    hard = spec["hard_constraints"]
    pairs = group_pairs(pattern, rules)
    if not pairs:
        raise Q.QueryError("no groups fit the pattern")
    chosen = draw(rng, pairs, [1.0] * len(pairs))
    reserved = {t for g in chosen if g for t in rules.groups[g][0]}
    for slot, field, table in (("genre_set", "genres", pools.genres), ("tag_set", "tags", {t: w for t, w in pools.tags.items() if t not in reserved})):
        if pattern[slot]:
            o, n = pattern[slot].split(":")
            values = sorted(table)
            if len(values) < int(n):
                raise Q.QueryError(f"too few {field} for the pattern")
            hard[field][o] = draw_without(rng, values, [table[v] for v in values], int(n))
    for slot, field, numbers in (("year_range", "year", pools.years), ("episodes_range", "episodes", pools.episodes)):
        if pattern[slot]:
            hard[field] = _bounds(pattern[slot], numbers, rng)
    for slot, field, values in (("format_any", "formats", sorted(rules.formats)), ("status_any", "status", sorted(rules.statuses))):
        if pattern[slot]:
            hard[field] = [draw(rng, values, [1.0] * len(values))]
    if pattern["reference"]:
        spec["reference_titles"] = [draw(rng, pools.titles, [1.0] * len(pools.titles))]
    hard["tag_groups"] = {o: [g] if g else [] for o, g in zip(Q.OPERATORS, (None, *chosen), strict=True)}
    if Q.count_clauses(spec) != pattern["n"]:
        raise Q.QueryError("the bound spec has other clauses than its pattern")
    return spec


def widen(spec: dict, rng: random.Random, rules: Q.Rules) -> None:
    """Formats and status, where used, become two values with a chance of TWO_VALUES each; the clause count stays."""
    hard = spec["hard_constraints"]
    for field, values in (("formats", sorted(rules.formats)), ("status", sorted(rules.statuses))):
        if hard[field] and rng.random() < TWO_VALUES and len(values) > 1:
            hard[field] = sorted(rng.sample(values, 2))


def styled(spec: dict, style: int, names: dict[str, dict[str, str]]) -> str:
    """The text of a spec in one of STYLES; names (by field) has other names of values, and values without one stand for themselves.

    Clauses follow the slots of a query, groups of tags after the slots of tags, and the reference comes last.
    """
    name, opening, separator = STYLES[style]
    words, hard = WORDINGS[name], spec["hard_constraints"]
    slots = [(field, part, hard[field][part] if part else hard[field]) for _, field, part, _ in Q.SLOTS]
    last_tag = max(k for k, (field, *_) in enumerate(slots) if field == "tags") + 1
    slots[last_tag:last_tag] = [("groups", o, hard.get("tag_groups", {}).get(o, [])) for o in Q.OPERATORS]
    slots.append(("reference_titles", None, spec["reference_titles"]))
    clauses = []
    for field, part, values in slots:
        shown = [names.get(field, {}).get(v, str(v)) for v in (values if isinstance(values, list) else [] if values is None else [values])]
        if shown:
            clauses.append(words["parts"][part].format(noun=words["nouns"][field], all=words["and"].join(shown), any=words["or"].join(shown)))
    return f"{opening} {separator.join(clauses)}"


RECORD = T.StructType().add("spec", "string").add("gold", "string").add("text", "string").add("signature", "string").add("clauses", "long").add(
    "rule_ids", T.ArrayType(T.StringType())
).add("style", "integer").add("error", "string")


def records(patterns: DataFrame, seed: str, rules: Q.Rules, pools: Pools, names: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """patterns (slots, n, a seed) with the struct `r`: gold query, text, signature, clauses, rule ids, style, or the error of a pattern that can't be bound.

    Texts follow TEMPLATES; with names they are those of a dataset: lists of two values, one of STYLES, names with a chance of
    OTHER_NAMES. Each row's draws come from its own seed, so rows are made in parallel and in any order.
    """

    @F.pandas_udf(RECORD)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in rows.to_dict("records"):
            p = {k: None if v != v else v for k, v in p.items()}
            try:
                rng, style = random.Random(int(p["seed"])), None
                spec = bind(p, rng, rules, pools)
                if names is not None:
                    widen(spec, rng, rules)
                    style = rng.randrange(len(STYLES))
                gold = Q.build(spec, rules)
                text = realised(gold, TEMPLATES) if names is None else styled(spec, style, names if rng.random() < OTHER_NAMES else {})
                out.append((canonical_json(spec), Q.dumps(gold), text, Q.signature(gold), Q.count_clauses(spec), Q.rule_ids(spec, rules), style, None))
            except Q.QueryError as e:
                out.append((None,) * (len(RECORD) - 1) + (str(e),))
        return pd.DataFrame(out, columns=RECORD.names).astype({"style": "Int32"})

    return patterns.withColumn("r", run(F.struct(*SLOTS, "n", F.col(seed).alias("seed"))))


def identified(rows: DataFrame, identity: list[str]) -> DataFrame:
    """rows with sample_id, a digest of the identity columns as JSON with sorted keys."""
    return rows.withColumn("sample_id", F.concat(F.lit("sample_"), sha256(to_canonical_json(F.struct(*sorted(identity))))))


def attempts(patterns: DataFrame, seed: str, rounds: int) -> DataFrame:
    """patterns in turn, by seed and family, `rounds` times over: place, the number of the attempt, and draw_seed, 32 bits of its own."""
    turn = F.row_number().over(Window.orderBy(seed, "family")) - 1  # patterns are a bounded table
    size = F.count("*").over(Window.partitionBy(F.lit(0)))
    rows = patterns.withColumn("_turn", turn.cast("long")).withColumn("_size", size).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    rows = rows.withColumn("place", F.col("_round") * F.col("_size") + F.col("_turn")).drop("_turn", "_size", "_round")
    return rows.withColumn("draw_seed", F.pmod(F.xxhash64(F.lit("dataset"), "place"), F.lit(1 << 32))).repartition(F.col("place"))


def dataset(
    patterns: DataFrame, seed: str, rules: Q.Rules, pools: Pools, used: DataFrame, n: int | None = None,
    names: dict[str, dict[str, str]] | None = None
) -> DataFrame:
    """n records (as many as patterns by default) whose text neither `used` (text) nor an earlier attempt has.

    Patterns take turns, each attempt with a seed of its own, until n texts are fresh; TRIES * n attempts without that are an error.
    Attempts are made in parallel, of equal texts the earliest stays, and the first n of these are the dataset: what one attempt
    after the other would give. Only the place of the last record comes to the driver.
    """
    size = patterns.count()
    n = size if n is None else n
    taken = used.select(F.col("text").alias("_used")).distinct()
    rounds, most = max(1, -(-n // max(1, size))), TRIES * n
    while True:
        tried = attempts(patterns, seed, rounds).where(F.col("place") < most)
        made = records(tried, "draw_seed", rules, pools, names or {}).where("r.error IS NULL").select("*", "r.*").drop("r", "error")
        fresh = made.join(taken, F.col("text") == F.col("_used"), "left_anti")
        first = fresh.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("_d")).agg(F.min_by(F.struct(*fresh.columns), "place").alias("_r")).select("_r.*")
        found = first.select("place").orderBy("place").limit(n).agg(F.count("*").alias("n"), F.max("place").alias("last")).first()
        if found.n == n:
            return identified(first.where(F.col("place") <= F.lit(found.last)), ["gold", "text", "draw_seed"])
        if rounds * size >= most:
            raise ValueError(f"{found.n} of {n} texts are fresh after {most} attempts")
        rounds *= 2


def check_records(rows: DataFrame, rules: Q.Rules, identity: list[str] | None = None) -> DataFrame:
    """Rows that aren't what their spec makes them, with `fault`: gold query, signature, clause count, rule ids, sample id.

    What a row has no column for is not looked at; without a spec the gold query is. identity has the columns of the sample id.
    """
    columns = [c for c in ("spec", "gold", "signature", "clauses", "rule_ids") if c in rows.columns]

    @F.pandas_udf(T.StringType())
    def fault(given: pd.DataFrame) -> pd.Series:
        out = []
        for r in given.to_dict("records"):
            try:
                q = json.loads(r["gold"])
                Q.check_domain(q, rules)
                want = {"gold": Q.dumps(q), "signature": Q.signature(q)}
                if r.get("spec") is not None:
                    spec = json.loads(r["spec"])
                    want |= {"gold": Q.dumps(Q.build(spec, rules)), "clauses": Q.count_clauses(spec), "rule_ids": Q.rule_ids(spec, rules)}
                got = r | ({"rule_ids": list(r["rule_ids"])} if "rule_ids" in r else {})
                out.append(next((f"{k} differs" for k, v in want.items() if k in got and got[k] != v), None))
            except (ValueError, TypeError, KeyError) as e:
                out.append(str(e))
        return pd.Series(out, dtype=object)

    checked = rows.withColumn("fault", fault(F.struct(*columns)))
    if identity is not None:
        own = F.concat(F.lit("sample_"), sha256(to_canonical_json(F.struct(*sorted(identity)))))
        checked = checked.withColumn("fault", F.coalesce("fault", F.when(~F.col("sample_id").eqNullSafe(own), "sample_id differs")))
    return checked.where("fault IS NOT NULL")


def sampled_records(rows: DataFrame, seed: str, sampler: Sampler, rules: Q.Rules, pools: Pools) -> DataFrame:
    """rows with the struct `r` of a record whose pattern and values one generator of each row's seed draws, in turn."""

    @F.pandas_udf(
        T.StructType().add("family", "string").add("bucket", "string").add("pos", "integer").add("gold", "string").add("signature", "string").add("clauses", "long").add("error", "string")
    )
    def run(seeds: pd.Series) -> pd.DataFrame:
        out = []
        for s in seeds:
            rng = random.Random(int(s))
            p = sampler.pattern(rng)
            try:
                spec = bind(p, rng, rules, pools)
                out.append((p["family"], p["bucket"], p["pos"], *Q.finished(spec, rules), Q.count_clauses(spec), None))
            except Q.QueryError as e:
                out.append((p["family"], p["bucket"], p["pos"], None, None, None, str(e)))
        return pd.DataFrame(out, columns=["family", "bucket", "pos", "gold", "signature", "clauses", "error"])

    return spread(rows).withColumn("r", run(F.col(seed)))
