"""Lookups of many rows in a keyed table without hot tasks, and a Bloom filter that spares rows which can't be found their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that has more than one in so many rows is hot; there are at most so many hot keys.
HOT = 1 << 14
#: Bits of a Bloom filter (8 MB, whatever the number of keys) and hashes of a key.
BITS, HASHES = 1 << 26, 2


def hot_keys(rows: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """The keys that more than one in `hot` rows has: at most `hot`, by one partial aggregation."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") * hot > F.col("_total")).select(key)  # one row


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows with the other columns of table, null where it lacks the key; table has one row for each value of `key`.

    Rows of the hot keys (hot_keys(), `key` alone) take their broadcast row where they are, and go on by position, so that no task
    gets all rows of one key. The rest, and all null keys by position too, is an ordinary join.
    """
    names = [c for c in table.columns if c != key]
    few = table.join(F.broadcast(hot), key, "left_semi").select(F.col(key).alias("_hot"), F.struct(F.lit(True), *names).alias("_hot_found"))
    listed = F.broadcast(hot.select(F.col(key).alias("_is_hot")).join(few, F.col("_is_hot") == F.col("_hot"), "left").drop("_hot"))
    rest = table.select(F.col(key).alias("_cold"), F.xxhash64(key).alias("_cold_slot"), F.struct(F.lit(True), *names).alias("_cold_found"))
    spread = rows.join(listed, F.col(key) == F.col("_is_hot"), "left")
    left = F.when(F.col("_is_hot").isNull(), F.col(key))  # null for hot keys: those rows match nothing more and are dealt by position
    slot = F.when(left.isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(left))
    found = spread.withColumn("_key", left).withColumn("_slot", slot).join(rest, (F.col("_key") == F.col("_cold")) & (F.col("_slot") == F.col("_cold_slot")), "left")
    got = F.coalesce(F.col("_hot_found"), F.col("_cold_found"))
    return found.select(*rows.columns, *[got[c].alias(c) for c in names])


def has_bit(bits: Column, place: Column) -> Column:
    """Is this bit of a bitmap (bitmap_construct_agg's) set?"""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BITS)) for seed in range(HASHES)]


def bloom(keys: DataFrame, key: str) -> DataFrame:
    """The filter of a key column: at most BITS / 32768 rows of 4 KB."""
    bit = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_bits(F.col(key)))).alias("b"))
    return bit.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))


def may_hold(rows: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """The rows whose key the filter may hold: none that it holds is lost."""
    found = rows
    for bit in _bits(F.col(key)):
        bits = F.broadcast(filters.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
        found = found.join(bits, F.bitmap_bucket_number(bit) == F.col("_bucket")).where(has_bit(F.col("_bits"), F.bitmap_bit_position(bit))).drop("_bucket", "_bits")
    return found
