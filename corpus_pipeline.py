"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns the columns of
documents; the last returns the pieces and their sequences. Nulls, empty texts and repeated rows go
through as each operator's module defines; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import encoders, exact_dedup, packing, pii, quality, simhash
from quillon.llm.common import collected, drop_scratch, labels, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, trained on the labels, gives a quality of 0.7 or more."""
    return quality.keep_good(docs, quality.trained(docs, labels(spark, sf_dir)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts stays, one row where it is repeated."""
    return exact_dedup.drop_copies(docs, repeats=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind's mask."""
    clean = pii.mask(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences of 1024."""
    return packing.pack(docs, encoders.path_of(encoders.BYTE_BPE))


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]

#: A trained network and the tokenizer's merges are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's tables are removed once the next one's result is written, those of the last stay for the caller to drop.

    The tables of other calls, in other threads as well, are not touched.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with collected() as made:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
            drop_scratch(spark, *made[:-1])
        return STAGES[-1][1](spark, docs, sf_dir)
