"""Catalogs whose files say what their rows have, so that a query leaves files out before Spark plans the scan.

A written catalog is clustered by its set values and has two more tables beside its rows: a vocabulary, which numbers the terms (genres, relevant and
present tags, formats, statuses), and a manifest with a row for each file: the terms that any of its rows has and those that all have, as bitmaps,
and the ranges of years and episodes. A file is left out if a term that a query needs is in none of its rows, if a term that it excludes is in
all of them, or if its ranges miss the query's. What is read is filtered by search.execute() as ever, so results are the same.

Terms beyond `TERMS` share the bits of others and are never said to be in all rows: files are then left out less often, never wrongly.

Defined results: null genres and tags are empty lists; a catalog without rows has no files and gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import search
from quillon.operators.joins import has_bit
from quillon.plans import query as Q

#: Terms that have a bit of their own: those of one bitmap.
TERMS = 1 << 15
ROWS, VOCABULARY, MANIFEST = "rows", "vocabulary", "manifest"


def terms() -> Column:
    """The terms of a catalog row, each once."""
    no_texts = F.array().cast("array<string>")
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    sets = [
        named("genre", F.coalesce("genres", no_texts)), named("relevant", search.relevant_tags()), named("present", search.relevant_tags(search.PRESENT)),
        named("format", F.array_compact(F.array("format"))), named("status", F.array_compact(F.array("status"))),
    ]
    return F.array_distinct(F.filter(F.concat(*sets), lambda t: t.isNotNull()))


def write(catalog: DataFrame, path: str, rows_of_file: int = 1 << 20, files: int | None = None) -> None:
    """A catalog with vocabulary and manifest; fails if path exists. Files have at most rows_of_file rows; files is the number of ranges (Spark's setting by default)."""
    spark, order = catalog.sparkSession, [F.array_join(F.array_sort("genres"), "\n"), F.col("format"), F.col("year"), F.col("id")]
    dealt = catalog.repartitionByRange(files, *order) if files else catalog.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_of_file).mode("errorifexists").parquet(f"{path}/{ROWS}")
    held = spark.read.schema(catalog.schema).parquet(f"{path}/{ROWS}").withColumn("file", F.col("_metadata.file_path"))
    counts = held.select("file", F.explode(terms()).alias("term")).groupBy("file", "term").agg(F.count("*").alias("n"))
    ordered = counts.select("term").distinct().orderBy("term")
    # numbers of a sorted column: whole and from 0 on, whatever its partitions, since one aggregate numbers them
    listed = ordered.agg(F.array_sort(F.collect_set("term")).alias("terms"))  # the vocabulary, not the rows
    listed.select(F.posexplode("terms").alias("number", "term")).write.parquet(f"{path}/{VOCABULARY}")
    vocabulary = spark.read.parquet(f"{path}/{VOCABULARY}")
    shared = vocabulary.agg(F.max("number")).first()[0] or 0
    facts = held.groupBy("file").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in Q.RANGES for n, f in (("min", F.min), ("max", F.max))])
    place = F.pmod(F.col("number"), F.lit(TERMS)).cast("long")
    every = (F.col("n") == F.col("rows")) & (F.col("number") + TERMS > shared) & (F.col("number") < TERMS)
    bits = counts.join(vocabulary, "term").join(facts.select("file", "rows"), "file").groupBy("file").agg(
        F.bitmap_construct_agg(place).alias("any"), F.bitmap_construct_agg(F.when(every, place)).alias("all")
    )
    facts.join(bits, "file", "left").coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{MANIFEST}")


def files_for(spark: SparkSession, path: str, q: dict) -> list[str]:
    """The files that may have rows which meet the query: as many names as the catalog has files, at most."""
    Q.check_structure(q)
    hard = q["hard_constraints"]
    wanted = {f"{kind}:{v}" for kind, f in (("genre", "genres"), ("relevant", "tags"), ("present", "tags")) for o in Q.OPERATORS for v in hard[f][o]}
    wanted |= {f"{kind}:{v}" for kind, f in (("format", "formats"), ("status", "status")) for v in hard[f]}
    known = {r.term: r.number % TERMS for r in spark.read.parquet(f"{path}/{VOCABULARY}").where(F.col("term").isin(*wanted)).collect()} if wanted else {}

    def has(bits: str, kind: str, value: str) -> Column:
        number = known.get(f"{kind}:{value}")
        return F.lit(False) if number is None else has_bit(F.col(bits), F.lit(number))

    some = lambda kind, values: reduce(Column.__or__, [has("any", kind, v) for v in values])
    found: list[Column] = []
    for f, need, ban in (("genres", "genre", "genre"), ("tags", "relevant", "present")):
        found += [has("any", need, v) for v in hard[f]["all_of"]] + ([some(need, hard[f]["any_of"])] if hard[f]["any_of"] else []) + [~has("all", ban, v) for v in hard[f]["none_of"]]
    found += [some(kind, hard[f]) for kind, f in (("format", "formats"), ("status", "status")) if hard[f]]
    for f in Q.RANGES:
        low, high = hard[f]["min"], hard[f]["max"]
        found += [F.coalesce(F.col(f"max_{f}") >= low, F.lit(False))] if low is not None else []
        found += [F.coalesce(F.col(f"min_{f}") <= high, F.lit(False))] if high is not None else []
    return [r.file for r in reduce(DataFrame.where, found, manifest(spark, path)).select("file").collect()]


def execute(spark: SparkSession, path: str, q: dict) -> DataFrame:
    """search.execute() over a written catalog, which reads only files_for() the query."""
    files = files_for(spark, path, q)
    schema = spark.read.parquet(f"{path}/{ROWS}").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return search.execute(q, rows)
