"""Filter, reference lookup, score and top k over a catalog, as one DataFrame plan.

Predicates are Columns and empty clauses are left out, so ranges and lists reach the Parquet scan as pushed filters
and sets are tested in generated code. Corpus statistics are one-row aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import fold_title, or_else, title_key
from quillon.plans import query as Q

#: Least rank of a tag that supports a wish, and of one that an exclusion removes.
RELEVANT, PRESENT = 50, 1


def relevant_tags(least: int = RELEVANT, tags: str = "tags") -> Column:
    """The distinct names of tags of at least this rank; a null rank is 0, null tags are none."""
    strong = F.filter(F.coalesce(F.col(tags), F.array().cast("array<struct<name:string,rank:int>>")), lambda t: F.coalesce(t["rank"], F.lit(0)) >= least)
    return F.array_distinct(F.transform(strong, lambda t: t["name"]))


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def has_all(values: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(_texts(wanted), values)) == 0


def has_any(values: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(values, _texts(wanted))


def has_none(values: Column, unwanted: list[str]) -> Column:
    return ~F.arrays_overlap(values, _texts(unwanted))


def within(value: Column, low: int | None, high: int | None) -> Column | None:
    """low <= value <= high; an unknown value proves no bound. None where nothing is bounded."""
    bounds = [*([value >= low] if low is not None else []), *([value <= high] if high is not None else [])]
    return reduce(Column.__and__, bounds) if bounds else None


def one_of(value: Column, values: list[str]) -> Column:
    return value.isin(values)


def hard_predicates(q: dict, relevant: int = RELEVANT, present: int = PRESENT) -> list[Column]:
    """The conditions of a query, each of which a row must meet."""
    hard = q["hard_constraints"]
    genres = F.coalesce(F.col("genres"), F.array().cast("array<string>"))
    found: list[Column | None] = []
    for f, wanted, unwanted in (("genres", genres, genres), ("tags", relevant_tags(relevant), relevant_tags(present))):
        c = hard[f]
        found += [has_all(wanted, c["all_of"])] if c["all_of"] else []
        found += [has_any(wanted, c["any_of"])] if c["any_of"] else []
        found += [has_none(unwanted, c["none_of"])] if c["none_of"] else []
    found += [within(F.col(f), hard[f]["min"], hard[f]["max"]) for f in Q.RANGES]
    found += [one_of(F.col(c), hard[f]) for f, c in (("formats", "format"), ("status", "status")) if hard[f]]
    return [c for c in found if c is not None]


def execute(q: dict, catalog: DataFrame, relevant: int = RELEVANT, present: int = PRESENT) -> DataFrame:
    """The rows of catalog that meet all hard constraints; a batch or a stream."""
    Q.check_structure(q)
    return reduce(DataFrame.where, hard_predicates(q, relevant, present), catalog)


def without_adult(catalog: DataFrame) -> DataFrame:
    return catalog.where(~F.coalesce(F.col("isAdult"), F.lit(False)))


def _keys(catalog: DataFrame) -> Column:
    """The folded titles of a row, each once."""
    return F.array_distinct(F.array(*[title_key(F.col(f"title.{n}")) for n in ("romaji", "english", "native")]))


def resolve(titles: list[str], catalog: DataFrame) -> DataFrame:
    """One row for each title: title, matches (rows with one of their titles equal under folding), id (of the only match, else null).

    Rows count and not ids: a row that is there twice is no single match. The wanted keys are as many as the query has
    titles; the catalog's titles are folded in one pass and never shuffled: rows are counted for each key.
    """
    spark = catalog.sparkSession
    wanted = spark.createDataFrame([(i, t, fold_title(t)) for i, t in enumerate(titles)], "pos int, title string, key string")
    asked = _texts(sorted({fold_title(t) for t in titles} - {""}))
    hits = catalog.select("id", _keys(catalog).alias("keys")).select("id", F.explode(F.array_intersect("keys", asked)).alias("key"))
    counted = hits.groupBy("key").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    return wanted.join(counted, "key", "left").select(
        "pos", "title", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("id")).alias("id")
    )


def corpus_facts(titles: list[str], catalog: DataFrame) -> DataFrame:
    """One row, by one pass over catalog: _top, its largest popularity, and of the rows that titles resolve to
    the number _refs, and the distinct _genres and relevant _tags."""
    keys = sorted({fold_title(t) for t in titles} - {""})
    top = F.coalesce(F.max("popularity"), F.lit(0)).alias("_top")
    none = F.array().cast("array<string>")
    if not keys:
        return catalog.agg(top, F.lit(0).alias("_refs"), none.alias("_genres"), none.alias("_tags"))
    facts = F.struct(F.coalesce("genres", none).alias("genres"), relevant_tags().alias("tags"))
    rows = catalog.select("id", "popularity", facts.alias("facts"), _keys(catalog).alias("keys"))
    hit = [F.array_contains("keys", k) for k in keys]
    found = rows.agg(
        top, *[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hit)],
        *[F.min_by("facts", F.when(h, F.col("id"))).alias(f"f{i}") for i, h in enumerate(hit)]
    )
    each = F.filter(F.array(*[F.when(F.col(f"n{i}") == 1, F.col(f"f{i}")) for i in range(len(keys))]), lambda x: x.isNotNull())
    union = lambda name: F.array_distinct(F.flatten(F.transform("_each", lambda x: x[name])))
    return found.withColumn("_each", each).select("_top", F.size("_each").alias("_refs"), union("genres").alias("_genres"), union("tags").alias("_tags"))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def popularity_part(top: Column) -> Column:
    return F.when(top > 0, 0.3 * F.ln(1.0 + F.coalesce("popularity", F.lit(0))) / F.ln(1.0 + top)).otherwise(0.0)


def average_part() -> Column:
    return 0.3 * F.coalesce("averageScore", F.lit(0)) / 100


def rank(q: dict, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """candidates with score and its components; sort by score descending, then id.

    The largest popularity of the whole catalog and the facts of resolved references come as one row, by one pass.
    """
    hard = q["hard_constraints"]
    wish = {f: sorted({*hard[f]["all_of"], *hard[f]["any_of"]}) for f in Q.SETS}
    rows = candidates.crossJoin(F.broadcast(corpus_facts(q["reference_titles"], catalog)))  # one row
    strong = relevant_tags()
    similar = F.when(F.col("_refs") > 0, jaccard(F.col("genres"), F.col("_genres")) + jaccard(strong, F.col("_tags"))).otherwise(0.0)
    parts = {
        "genre_overlap": F.size(F.array_intersect("genres", _texts(wish["genres"]))) * 0.2,
        "tag_overlap": F.size(F.array_intersect(strong, _texts(wish["tags"]))) * 0.2,
        "reference_similarity": similar,
        "popularity": popularity_part(F.col("_top")),
        "average_score": average_part(),
    }
    scored = rows.withColumn("components", F.struct(*[c.alias(n) for n, c in parts.items()]))
    total = reduce(Column.__add__, [F.col(f"components.{n}") for n in parts])
    return scored.withColumn("score", F.round(total, 8)).drop("_top", "_genres", "_tags", "_refs")


def top(q: dict, catalog: DataFrame, k: int = 20) -> DataFrame:
    """The k best rows that meet the query."""
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    return rank(q, execute(q, catalog), catalog).orderBy(F.desc("score"), "id").limit(k)


def presented(ranked: DataFrame, vocabulary: list[str]) -> DataFrame:
    """id, title, shown tags and score, as a result list shows them."""
    title = or_else(F.col("title.english"), F.col("title.romaji"), F.col("title.native"))
    return ranked.select("id", title.alias("title"), F.array_sort(F.array_intersect(relevant_tags(), _texts(vocabulary))).alias("shown_tags"), "score")


def popular_pool(catalog: DataFrame, n: int = 200) -> DataFrame:
    """The n most popular rows' names, sorted."""
    best = catalog.select("id", or_else(F.col("title.english"), F.col("title.romaji")).alias("title"), F.coalesce("popularity", F.lit(0)).alias("popularity"))
    return best.orderBy(F.desc("popularity"), "id").limit(n).orderBy("title", "id")
