"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Three stages, each of which compares the full normalised text, never only its digest: copies meet
inside each task (Spark's partial aggregation; rows of a task have one salt), then inside a salted digest group, then the few
salt winners of a digest meet. A hot text thus costs each task one row and each salt one row, whatever its doc_ids.
That every digest has one text only follows from the last stage: the winners of a digest with several texts would be
several, and then the query stops with an error. So the decision, a narrow table in the shared folder, may travel back to
the rows by digest; of digests that many rows have it is broadcast (common.looked_up).

Defined results: a null text is the empty text. A row with a null doc_id stays only if no row of
its group has an id. Rows repeated under one doc_id are one document and share its decision.
No rows in, no rows out. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import looked_up, written

#: Salts of one digest: the largest share of a hot group that one task has to take is 1 / SALTS.
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def winners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("body"))
    rows = rows.select("doc_id", "body", _digest(F.col("body")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    combined = salted.groupBy("digest", "body").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    one = combined.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts have one SHA-256"))).otherwise(F.col("group_size"))
    return one.select("digest", "keep_id", sure.alias("group_size"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, *_decided(docs, doc_id, text, salts), doc_id, text)


def _decided(docs: DataFrame, doc_id: str, text: str, salts: int) -> tuple[DataFrame, int]:
    """(winners() as a written table, number of rows)."""
    decided = written(winners(docs, doc_id, text, salts), "winners")
    return decided, decided.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]


def _groups(docs: DataFrame, decided: DataFrame, total: int, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), _digest(normalised(F.col(text))).alias("digest"))
    found = looked_up(rows, decided.select("digest", "keep_id", "group_size", F.col("group_size").alias("rows")), "digest", "rows", total)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, repeats: bool = True) -> DataFrame:
    """docs, all columns, without the rows whose text a row with a smaller doc_id has.

    Rows that repeat the text under the same doc_id (or all without one) stay all with `repeats`, else one of them. Rows of hot texts
    take their decision where they are, and repeated rows are combined inside each task first.
    """
    decided, total = _decided(docs, doc_id, text, salts)
    table = decided.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id"), F.col("group_size").alias("__rows"))
    rows = docs.withColumn("__digest", _digest(normalised(docs[text])))
    stay = looked_up(rows, table, "__digest", "__rows", total).where(F.col(doc_id).eqNullSafe(F.col("__keep_id")))
    if not repeats:
        names = docs.columns
        own = F.concat_ws(":", F.hex("__digest"), F.col(doc_id).cast("string"))
        narrow = _groups(docs, decided, total, doc_id, text).where("kept")
        counts = narrow.groupBy(F.concat_ws(":", F.upper("text_sha256"), F.col("doc_id").cast("string")).alias("__own")).agg(F.count("*").alias("__rows")).where("__rows > 1")
        again = written(counts.withColumn("__again", F.lit(True)), "repeats")
        n = again.agg(F.sum("__rows")).first()[0]
        if n:  # rows under one id with one text, those without an id included
            marked = looked_up(stay.select(*names, own.alias("__own")), again, "__own", "__rows", total)
            first = marked.where("__again").groupBy("__own").agg(F.first(F.struct(*[F.col(c) for c in names])).alias("__first")).select("__first.*")
            return marked.where("__again IS NULL").select(*names).unionAll(first.select(*names))
    return stay.select(*docs.columns)
