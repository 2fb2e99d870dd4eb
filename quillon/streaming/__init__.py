"""Searches over catalogs that arrive as files; filters are stateless, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.search import execute
from quillon.sources.schemas import CATALOG


def catalog_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CATALOG).option("maxFilesPerTrigger", files_per_batch).json(path)


def matches(q: dict, stream: DataFrame) -> DataFrame:
    """The rows of the stream that meet the query."""
    return execute(q, stream)
