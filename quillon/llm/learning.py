"""Labelled samples for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, most_bytes: int = 64 << 20
) -> tuple[list[str], list[int]]:
    """(texts, labels) of labelled documents outside the held-out fold: `rows` at most, of `most_bytes` of text together at most.

    They are chosen in order of a hash of doc_id, on the narrow label table; a document that would exceed most_bytes is passed
    over. One scan gives their sizes, a second the texts of those taken.
    Null labels and null ids are left out; a null text is the empty text; of repeated ids the least label and the least text count.
    """
    known = labels.select(
        F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")
    ).where("doc_id IS NOT NULL AND label IS NOT NULL").where(fold(F.col("doc_id"), folds) != held_out)
    chosen = {}
    for r in known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
        chosen[r.doc_id] = r.label

    def found(ids: list[int], value: Column) -> dict:
        """The least value of each of these ids: `rows` values at most."""
        few = docs.sparkSession.createDataFrame([(k,) for k in ids], "_chosen long")
        hits = docs.join(F.broadcast(few), docs["doc_id"] == few["_chosen"]).select(few["_chosen"].alias("k"), value.alias("v"))
        return {r.k: r.v for r in hits.groupBy("k").agg(F.min("v").alias("v")).collect()}

    sizes = found(list(chosen), F.coalesce(F.octet_length(docs["text"]), F.lit(0))) if chosen else {}
    taken, held = [], 0
    for k in chosen:
        if k in sizes and held + sizes[k] <= most_bytes:
            taken.append(k)
            held += sizes[k]
    texts = found(taken, F.coalesce(docs["text"], F.lit(""))) if taken else {}
    ids = sorted(texts)
    return [texts[k] for k in ids], [chosen[k] for k in ids]
