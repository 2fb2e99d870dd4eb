"""Numbered lines of text files, and numbered rows of ordered tables, by prefix sums over their parts.

Each part (a split of a file, a partition of a sorted table) counts its rows; sums of these counts, a table of one row for each part, tell
what stands before a part, and its rows number themselves. No row is sorted again for that, and no task sees a whole file.

Lines end as Spark's text source ends them: CR, LF or both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import written

#: Parts up to which their sums are broadcast (100 bytes each); beyond, Spark chooses.
MOST_PARTS = 1 << 20


def _before(counts: DataFrame, n: str, order: list[str], within: list[str] | None = None) -> Column:
    return F.sum(n).over((Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def _small(parts: DataFrame) -> DataFrame:
    return F.broadcast(parts) if parts.count() <= MOST_PARTS else parts


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (1 is a file's first), row (1 is the first line of the first file by name), value."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_id"), "value")
    parts = lines.groupBy("file_path", "file_block_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    parts = written(parts, "splits")  # as many as the files have splits
    parts = parts.select(
        F.col("file_path").alias("_file"), F.col("file_block_start").alias("_start"), "_n", "_first",
        F.coalesce(_before(parts, "_n", ["file_block_start"], ["file_path"]), F.lit(0)).alias("_in_file"),
        F.coalesce(_before(parts, "_n", ["file_path", "file_block_start"]), F.lit(0)).alias("_in_all"),
    )
    found = lines.join(_small(parts), (F.col("file_path") == F.col("_file")) & (F.col("file_block_start") == F.col("_start")))
    place = F.col("_id") - F.col("_first") + 1
    place = F.when(place.between(1, F.col("_n")), place).otherwise(F.raise_error(F.lit("a file has changed while it was read")).cast("long"))
    return found.select(F.col("file_path").alias("file"), (place + F.col("_in_file")).alias("line"), (place + F.col("_in_all")).alias("row"), "value")


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows sorted by these columns, with their number from 1 on in the column `row`."""
    held = written(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    parts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    parts = parts.select("_part", "_first", F.coalesce(_before(parts, "_n", ["_part"]), F.lit(0)).alias("_before"))
    found = held.join(_small(parts), part == F.col("_part"))
    return found.withColumn("row", F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_id", "_part", "_first", "_before")


def judged(lines: DataFrame, rules: dict[str, Column], keep: list[str | Column], value: str = "value") -> DataFrame:
    """The written columns `keep` (which may use `v`) of all lines (numbered) but blank ones, with `reason`: no JSON object, or the first rule that is broken, else null.

    A key that is there twice, or anything after the object, makes a line no JSON.
    rules are conditions over the column `v`, the line as a variant: kind_of("id") is the type of a field. The table is written since a
    filter on `reason` would otherwise reach the scan with the parse of the line repeated in it for every rule.
    """
    found = lines.where(F.trim(F.col(value)) != "").withColumn("v", F.try_parse_json(F.concat(F.lit('{"_":'), value, F.lit("}"))))
    # a parse ends with the first value; what may follow it inside an object and what may inside a list exclude each other
    alone = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))).isNotNull()
    found = found.withColumn("v", F.when(alone, F.variant_get("v", "$._", "variant")))
    checks = [(F.col("v").isNull(), "no JSON"), (~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "no JSON object")]
    reason = F.coalesce(*[F.when(c, r) for c, r in checks], *[F.when(F.coalesce(c, F.lit(True)), r) for r, c in rules.items()])
    return written(found.select(*keep, reason.alias("reason")), "judged")


def faults(lines: DataFrame, rules: dict[str, Column], value: str = "value") -> DataFrame:
    """The lines that judged() has a reason against."""
    return judged(lines, rules, lines.columns, value).where("reason IS NOT NULL")


def kind_of(field: str) -> Column:
    """The type of a field of the line: BIGINT, STRING, OBJECT, ARRAY, VOID for null, DECIMAL, BOOLEAN; "" where there is none."""
    kind = F.schema_of_variant(F.variant_get("v", f"$.{field}", "variant"))
    return F.regexp_extract(F.coalesce(kind, F.lit("")), r"^[A-Z]*", 0)


def text_of(field: str) -> Column:
    return F.try_variant_get("v", f"$.{field}", "string")
