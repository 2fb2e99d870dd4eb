"""Catalogs: JSON Lines in and out, page files, normalisation and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import or_else, sha256, to_canonical_json
from quillon.sources.lines import judged, kind_of, numbered, text_of
from quillon.sources.schemas import CATALOG, PAGE


class CatalogError(ValueError):
    """What a catalog has wrong."""


def file_sha256(spark: SparkSession, path: str) -> str | None:
    """The SHA-256 of one file's bytes in any file system that Spark reads, as a stream of bounded memory; None where path is no file."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or not files.getFileStatus(where).isFile():
        return None
    stream = files.open(where)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def read_catalog(spark: SparkSession, path: str, sha256_of_file: str | None = None, rows: int | None = None) -> DataFrame:
    """A catalog of one JSON object a line. Rejects malformed lines and repeated ids by their places (line_faults()), no rows at all, and other bytes or counts than a manifest says."""
    if sha256_of_file is not None and file_sha256(spark, path) != sha256_of_file:
        raise CatalogError("the file's bytes are not those of the manifest")
    if wrong := first_faults(line_faults(spark, path)):
        raise CatalogError(wrong)
    catalog = spark.read.schema(CATALOG).option("mode", "FAILFAST").json(path)
    check(catalog, rows)
    return catalog


def line_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, line, row, reason of the lines of a catalog that can't be its rows: no JSON object, fields of other types, an id that an earlier line has.

    Types: id a whole number, genres and tags lists, title an object, title texts strings or null, year, episodes and ranks whole numbers or null.
    """
    lines = numbered(spark, path)
    kind = kind_of
    rules = {"id is no whole number": kind("id") != "BIGINT", "genres is no list": kind("genres") != "ARRAY", "tags is no list": kind("tags") != "ARRAY", "title is no object": kind("title") != "OBJECT"}
    rules |= {f"title.{n} is no text": ~kind(f"title.{n}").isin("STRING", "VOID", "") for n in ("romaji", "english", "native")}
    rules |= {f"{n} is no whole number": ~kind(n).isin("BIGINT", "VOID", "") for n in ("year", "episodes", "averageScore", "popularity")}
    found = judged(lines, rules, ["file", "line", "row", text_of("id").alias("id")])
    wrong = found.where("reason IS NOT NULL").select("file", "line", "row", "reason")
    ids = found.where("reason IS NULL").drop("reason")
    first = ids.groupBy("id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = ids.join(first, "id").where(F.col("row") > F.col("first"))
    return wrong.unionAll(again.select("file", "line", "row", F.concat(F.lit("the id of row "), F.col("first").cast("string")).alias("reason")))


def first_faults(found: DataFrame, most: int = 20) -> str:
    """The first of the faults as text, "" where there are none."""
    rows = found.orderBy("row").limit(most).collect()
    return "; ".join(f"{r.file.rsplit('/', 1)[-1]}:{r.line}: {r.reason}" for r in rows)


def check(catalog: DataFrame, rows: int | None = None) -> None:
    """One aggregate over the catalog; raises CatalogError."""
    ids = catalog.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(F.col("genres").isNull() | F.col("tags").isNull() | F.col("title").isNull()).alias("bad")
    )
    s = ids.agg(F.sum("n").alias("n"), F.count_if((F.col("n") > 1) | F.col("id").isNull()).alias("twice"), F.sum("bad").alias("bad")).first()
    if not s.n or rows is not None and s.n != rows:
        raise CatalogError(f"{s.n or 0} rows" + f", {rows} expected" * (rows is not None))
    if s.twice or s.bad:
        raise CatalogError(f"{s.twice} ids missing or repeated, {s.bad} rows without genres, tags or title")


def normalised_tags(tags: Column) -> Column:
    """Tags with rank 0 for none, sorted by name, then rank."""
    return F.array_sort(F.transform(tags, lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["rank"], F.lit(0)).alias("rank"))))


def normalise(media: DataFrame) -> DataFrame:
    """Raw media rows: year from the start date or else the season, genres sorted and distinct, tags ranked and sorted."""
    return media.withColumns(
        {
            "year": or_else(F.col("startDate.year"), F.col("seasonYear")), "genres": F.array_sort(F.array_distinct("genres")),
            "tags": normalised_tags(F.col("tags"))
        }
    )


def violations(media: DataFrame) -> DataFrame:
    """Rows that no catalog may have, with `violation`: no positive id, no title at all, missing lists, ranks outside 0..100."""
    rules = {
        "id": ~F.coalesce(F.col("id") >= 1, F.lit(False)),
        "title": F.coalesce(F.concat("title.romaji", "title.english", "title.native"), F.concat_ws("", "title.romaji", "title.english", "title.native")) == "",
        "genres": F.col("genres").isNull(),
        "tags": F.col("tags").isNull(),
        "rank": F.exists("tags", lambda t: ~t["rank"].between(0, 100)),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return media.withColumn("violation", F.explode(found))


def latest(rows: DataFrame, key: Column | str, order: list[Column | str]) -> DataFrame:
    """Of the rows of each key the one with the greatest order: the last write wins."""
    greatest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(greatest)).where("_n = 1").drop("_n")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Cached page files, one JSON object each: media that aren't adult, of each id the last by schedule, page and place."""
    media = spark.read.schema(PAGE).json(path).select("schedule", "page", F.posexplode("data.Page.media").alias("pos", "m"))
    rows = latest(media.where(~F.coalesce("m.isAdult", F.lit(False))), "m.id", ["schedule", "page", "pos"])
    return normalise(rows.select("m.*"))


def canonical_lines(catalog: DataFrame) -> DataFrame:
    """(id, value): each row as compact JSON with sorted keys."""
    return catalog.select("id", to_canonical_json(_alphabetical(catalog)).alias("value"))


def _alphabetical(df: DataFrame) -> Column:
    def of(c: Column, kind) -> Column:
        name = kind.typeName()
        if name == "struct":
            return F.when(c.isNotNull(), F.struct(*[of(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if name == "array" and kind.elementType.typeName() in ("struct", "array"):
            return F.transform(c, lambda x: of(x, kind.elementType))
        return c

    return F.struct(*[of(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def write_lines(catalog: DataFrame, path: str) -> None:
    """Canonical JSON Lines in order of id, in as many files as the sort has ranges; fails if path exists."""
    canonical_lines(catalog).orderBy("id").select("value").write.mode("errorifexists").text(path)


def table_sha256(df: DataFrame, key: str, fan: int = 4096) -> DataFrame:
    """One row: a SHA-256 in which order (of a unique whole-number key, 0 or more) and content both count.

    A tree of digests: rows, then blocks of `fan` keys, blocks of blocks, and their row, so a task holds `fan` digests at
    most. It has two levels of blocks below the root, and more where the largest key needs them.
    """
    level = df.select(F.col(key).cast("long").alias("k"), sha256(to_canonical_json(_alphabetical(df))).alias("h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    most, levels = df.agg(F.max(F.col(key).cast("long"))).first()[0] or 0, 2
    while most >= fan ** (levels + 1):
        levels += 1
    for _ in range(levels):
        level = level.groupBy(F.floor(F.col("k") / fan).alias("k")).agg(F.sha2(listed.cast("binary"), 256).alias("h"))
    return level.agg(F.sha2(listed.cast("binary"), 256).alias("sha256"))


def split_bad(media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows keep the reasons, for a quarantine table."""
    bad = violations(media)
    return media.join(bad.select("id").distinct(), "id", "left_anti").where("id IS NOT NULL"), bad
