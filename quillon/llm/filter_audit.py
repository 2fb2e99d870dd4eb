"""How filters of a corpus interact: for every order of five filters, what each removes after those before it.

A document fails A with under `FEWEST` words, B where few of its words are distinct, C where too many of its characters are capital letters, D
with one of some marks, and E if a row with a smaller doc_id has the same text.

E is found by partition refinement. Rows are classed by their length in code points, and those alone in their class are dropped; classes are then
split by the hash of one block of the text after the other, again without the rows that are left alone. The texts of what remains are compared in
full: only texts whose class has a bit in a map of fixed size are looked at, and they meet by class and text, inside each task first, so
a text with many copies travels once per task. Where all hashes of different texts agree, rows get their decision by text and not by class.

Counting: rows become counts of (part, mask of failed filters, labels); what a filter removes after a set of others depends on that set
alone, so 80 sums for each part give all 120 orders.

Defined results: a null text is the empty text, a null or empty source the part "". A row without doc_id never fails E and makes no other row fail
it. Rows repeated under one doc_id don't fail E by each other. A label is 1 if any label row of the doc_id says so. No rows
in, no rows out. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import looked_up, written

FILTERS = "ABCDE"
FEWEST, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
MARKS = "[#$%&*|]"
#: Code points at which the blocks of a text begin; the last has the rest of it.
BLOCKS = (0, 256, 4096)
#: Bits of the map of classes: 8 MB, whatever the number of classes.
BITS = 1 << 26
COPY = 1 << FILTERS.index("E")

Hash = Callable[[Column], Column]


def blocks(body: Column, hashed: Hash = F.xxhash64) -> list[Column]:
    """The hash of each block of a text; null where the text has ended before."""
    ends = [*BLOCKS[1:], 2**31 - 1]
    return [F.when(F.length(body) > a, hashed(F.substring(body, a + 1, b - a))) for a, b in zip(BLOCKS, ends, strict=True)]


def split(found: Column, block: Column) -> Column:
    """The class that a block's hash makes of a class."""
    return F.when(block.isNull(), found).otherwise(F.xxhash64(found, block))


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", hashed: Hash = F.xxhash64) -> DataFrame:
    """Rows by one scan: doc_id, part, the mask of A to D, the class by length, the hash of each block, and the body."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("body")
    )
    rows = rows.withColumn("words", F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, size = F.size("words"), F.length("body")
    fails = [
        n < FEWEST, 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n, 100 * F.regexp_count("body", F.lit("[A-Z]")) > CAPITAL_PERCENT * size,
        F.col("body").rlike(MARKS)
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")
    hashes = [b.alias(f"block{k}") for k, b in enumerate(blocks(F.col("body"), hashed))]
    return rows.select("doc_id", "part", mask.alias("mask"), size.cast("long").alias("class"), *hashes, "body")


def _refined(rows: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows that are never alone, with the last class; those left alone by each round)."""
    alone = []
    for k in range(len(BLOCKS) + 1):
        if k:
            rows = rows.withColumn("class", split(F.col("class"), F.col(f"block{k - 1}")))
        several = rows.groupBy("class").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("several", F.lit(True))
        found = written(looked_up(rows, written(several, "classes"), "class", "rows", total), "refined")
        alone.append(found.where("several IS NULL").drop("several"))
        rows = found.where("several").drop("several")
    return rows, alone


def _may_be_in(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows whose class is one of these, and few others: a map of BITS bits, which is broadcast."""
    bit = lambda df: F.pmod(df["class"], F.lit(BITS))
    bits = classes.groupBy(F.bitmap_bucket_number(bit(classes)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(classes))).alias("_bits"))
    place = F.bitmap_bit_position(bit(rows))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit(rows)) == F.col("_bucket"))
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def copies(bodies: DataFrame, rows: DataFrame, salts: int = 64) -> DataFrame:
    """doc_id, part and mask of rows, what _refined() left of bodies, with the bit of E where a smaller doc_id has the same text."""
    for k in range(len(BLOCKS)):
        bodies = bodies.withColumn("class", split(F.col("class"), F.col(f"block{k}")))
    bodies = _may_be_in(bodies.select("doc_id", "part", "mask", "class", "body"), rows.select("class"))
    salted = bodies.groupBy("class", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "body").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    texts = salted.groupBy("class", "body").agg(F.min("least").alias("least"), F.sum("n").alias("rows"))
    decided = written(texts.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.sum("rows").alias("rows")), "copies")
    total, odd = decided.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(F.col("texts") > 1)).first()
    marked = looked_up(rows, decided, "class", "rows", total)
    if odd:  # different texts of one class: their rows are looked up by the text itself
        mixed = decided.where("texts > 1").select("class")
        within = lambda df: df.join(mixed, "class", "left_semi")
        apart = looked_up(within(bodies), written(within(texts).select("body", "least", "rows"), "texts"), "body", "rows", total)
        marked = marked.where("texts = 1").select("doc_id", "part", "mask", "least").unionAll(apart.select("doc_id", "part", "mask", "least"))
    return marked.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), COPY).otherwise(0)).alias("mask"))


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", hashed: Hash = F.xxhash64) -> DataFrame:
    """One row for each of docs: doc_id, part, mask of the filters it fails (A is 1, E is 16)."""
    bodies = failures(docs, doc_id, text, source, hashed)
    narrow = written(bodies.drop("body"), "failures")
    several, alone = _refined(narrow, narrow.count())
    found = copies(bodies, several)
    for rows in alone:
        found = found.unionAll(rows.select("doc_id", "part", "mask"))
    return found


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, set of the filters before it, filter) of each step of each order."""
    return [
        ("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(len(FILTERS))
    ]


def interactions(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order keeps and removes in each part, from masks of documents and their labels."""
    same = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    n = F.col("n")
    counts = same.join(known, F.col("doc_id") == F.col("_id"), "left").groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )
    steps = sorted({(before, k) for _, _, before, k in orders()})
    listed = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(k).alias("filter"), F.lit(1 << k).alias("bit")) for before, k in steps])
    rows = counts.withColumn("_step", F.explode(listed)).select("*", "_step.*")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    fails, passed = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) == 0
    of = lambda condition, value, name: F.sum(F.when(condition, value).otherwise(0)).cast("long").alias(name)
    share = n * (F.lit(len(orders()) // len(FILTERS)) / F.bit_count(mask)).cast("long")
    sums = rows.groupBy("part", "before", "filter").agg(
        of(~fails & passed, n, "kept"), of(fails & passed, n, "removed"), of(fails & ~passed, n, "redundant"), of(mask == bit, n, "unique_fails"),
        of(fails & passed, F.col("good"), "good_lost"), of(fails & passed, F.col("toxic"), "toxic_lost"), of(fails, share, "shapley"),
    )
    places = masked.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, filter int")
    found = sums.join(F.broadcast(places), ["before", "filter"])  # 600 rows
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each part, order of the filters, and step."""
    return interactions(masks(docs, doc_id, text, source), labels)
