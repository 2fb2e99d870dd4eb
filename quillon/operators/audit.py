"""Audits of datasets: overlaps between splits, duplicates, frequencies, lengths, identities."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import order_statistics


def excess(key: Column) -> Column:
    """Rows beyond the first of each key; a null key is a key of its own kind."""
    return F.count("*") - F.count_distinct(F.coalesce(key.cast("string"), F.lit("\0")))


def duplicate_excess(rows: DataFrame, split: str, keys: dict[str, Column]) -> DataFrame:
    """split, key, excess: keys are made short digests first, so that long texts are shuffled once as 32 bytes."""
    made = rows.select(
        split,
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("key"), F.sha2(F.coalesce(c.cast("string"), F.lit("\0")).cast("binary"), 256).alias("d")) for n, c in keys.items()]
            )
        ).alias("_k")
    )
    each = made.groupBy(split, "_k.key", "_k.d").agg(F.count("*").alias("n"))
    return each.groupBy(split, "key").agg(F.sum(F.col("n") - 1).alias("excess"))


def split_overlap(rows: DataFrame, split: str, keys: dict[str, Column]) -> DataFrame:
    """split_a < split_b, key, shared: distinct keys that both splits have. One aggregation by key, no self-join."""
    made = rows.select(
        split,
        F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.sha2(c.cast("string").cast("binary"), 256).alias("d")) for n, c in keys.items()])).alias("_k")
    ).where("_k.d IS NOT NULL")
    sets = made.groupBy("_k.key", "_k.d").agg(F.array_sort(F.collect_set(split)).alias("s")).where("size(s) > 1")
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select("key", F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b", "key").agg(F.count("*").alias("shared"))


def hygiene_errors(overlap: DataFrame, excesses: DataFrame, strict: tuple[str, ...] = ("text", "text_gold"), split: str = "split") -> DataFrame:
    """What is not allowed: shared strict keys between splits; repeated strict keys inside validation or test."""
    shared = overlap.where(F.col("key").isin(*strict) & (F.col("shared") > 0)).select(
        F.concat_ws("/", "split_a", "split_b").alias("where"), "key", F.col("shared").alias("n")
    )
    inside = excesses.where(
        F.col("key").isin(*strict) & F.col(split).isin("validation", "test") & (F.col("excess") > 0)
    ).select(F.col(split).alias("where"), "key", F.col("excess").alias("n"))
    return shared.union(inside)


def by_owner(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """rows with the split of their template; owners (key, split) has one row for each template."""
    return rows.join(owners, key)


def first_unused(rows: DataFrame, used: DataFrame, text: str, order: str) -> DataFrame:
    """Rows whose text nobody used: not in `used`, and of those with equal texts the first by `order`.

    One row for each text: a null order comes last, and of equal orders any one stays. Rows without a text are left out.
    """
    fresh = rows.where(F.col(text).isNotNull()).join(used.select(F.col(text).alias("_used")).distinct(), F.col(text) == F.col("_used"), "left_anti")
    digest = F.sha2(F.col(text).cast("binary"), 256).alias("_d")
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col(order).isNull(), F.col(order)))
    return fresh.groupBy(digest).agg(first.alias("_r")).select("_r.*")


def outside(rows: DataFrame, value: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose value is in no row of the first column of vocabulary; a null value is in none."""
    allowed = vocabulary.select(F.col(vocabulary.columns[0]).alias("_v")).distinct()
    return rows.join(allowed, F.col(value) == F.col("_v"), "left_anti")


def dataset_audit(rows: DataFrame, by: str, values: str, listed: str) -> DataFrame:
    """For each `by`: rows, distinct `values` and their list, and rows whose array `listed` has several."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_distinct(values).alias("distinct"), F.count_if(F.size(listed) > 1).alias("several"), F.array_sort(F.collect_set(values)).alias("all_values")
    )


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """For all rows, or each group: for each name the value at place ceil(share * n) of the sorted values; exact, and no task holds a group's values."""
    return order_statistics.at_places(rows, by or [], value, {name: order_statistics.share(p) for name, p in shares.items()})


def tag_frequency(catalog: DataFrame, least: int = 50) -> DataFrame:
    """The rows that have each tag with at least this rank."""
    return catalog.select(F.explode("tags").alias("t")).where(F.col("t.rank") >= least).groupBy(F.col("t.name").alias("tag")).agg(F.count("*").alias("n"))


def frequencies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n for several columns in one aggregation."""
    made = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_f"))
    return made.groupBy("_f.column", "_f.value").agg(F.count("*").alias("n"))


def length_summary(rows: DataFrame, by: list[str], length: str) -> DataFrame:
    """count, least, median, p95 (nearest rank) and most of a length; rows without a length count, and are no values."""
    places = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1, "p95": order_statistics.share(0.95)}
    values = order_statistics.at_places(rows, by, length, places)
    values = values.select(*[F.col(c).alias(f"_by_{c}") for c in by], ((F.col("_low") + F.col("_high")) / 2).alias("median"), F.col("p95").cast("long").alias("p95"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(length).alias("least"), F.max(length).alias("most"))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True))
    return counts.join(values, on, "left").select(*by, "n", "least", "median", "p95", "most")


def ids_sha256(rows: DataFrame, by: list[str], pos: str, sample_id: str) -> DataFrame:
    """For each group the SHA-256 of the JSON array of its ids in order of pos, and their number.

    Rows are sorted in their task, and the digest goes on from batch to batch, so memory doesn't grow with a group. An id that a group has
    twice is an error. Null ids are JSON nulls and may repeat.
    """
    twice = rows.where(F.col(sample_id).isNotNull()).groupBy(*by, sample_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"an id is there twice: {twice[0].asDict()}")
    value = F.coalesce(F.to_json(F.array(sample_id), {"ignoreNullFields": "false"}), F.lit("[null]"))
    keyed = rows.select(F.struct(*by).alias("g"), F.col(pos).alias("pos"), value.substr(F.lit(2), F.length(value) - 2).alias("id"))
    ordered = keyed.repartition("g").sortWithinPartitions("g", "pos", "id").select("g", "id")

    def fold(batches):
        group, digest, n = None, None, 0
        for batch in batches:
            keys, first = batch.column(0), 0
            codes = keys.to_pylist()
            ids = batch.column(1).to_pylist()
            done, sums, counts = [], [], []
            while first < len(codes):
                if digest is None or codes[first] != group:
                    if digest is not None:
                        done.append(group)
                        sums.append(_closed(digest))
                        counts.append(n)
                    group, digest, n = codes[first], hashlib.sha256(b"["), 0
                last = first
                while last < len(codes) and codes[last] == group:
                    last += 1
                digest.update((b"," if n else b"") + ",".join(ids[first:last]).encode())
                n, first = n + last - first, last
            if done:
                yield _groups(done, sums, counts, keys.type)
        if digest is not None:
            yield _groups([group], [_closed(digest)], [n], keys.type)

    schema = T.StructType([T.StructField("g", ordered.schema["g"].dataType), T.StructField("sha256", T.StringType()), T.StructField("n", T.LongType())])
    return ordered.mapInArrow(fold, schema).select("g.*", "sha256", "n")


def _closed(digest) -> str:
    digest.update(b"]")
    return digest.hexdigest()


def _groups(groups: list, sums: list[str], counts: list[int], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(groups, kind), pa.array(sums, pa.string()), pa.array(counts, pa.int64())], names=["g", "sha256", "n"])


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
