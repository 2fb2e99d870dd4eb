"""Features for supervised fine-tuning: messages, completion-only labels, padding, lengths."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = -100
#: Token ids that a Python worker holds at most, besides those of one row.
PART = 1 << 18


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: str, user: Column, answer: Column | None = None) -> Column:
    """[system, user] for inference, [system, user, assistant] for training."""
    parts = [message("system", F.lit(system)), message("user", user)]
    return F.array(*parts, *([message("assistant", answer)] if answer is not None else []))


def tokenised(rows: DataFrame, text: str, to: str, encode: Callable[[str], list[int]]) -> DataFrame:
    """rows with the ids of a text; encode is called once a row inside Arrow batches, whose ids leave in parts of `PART` ids and one row."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, ends = array("i"), [0]
            for t in batch:
                found.extend(encode(t.as_py() or ""))
                ends.append(len(found))
                if len(found) >= PART:
                    yield _lists(found, ends)
                    found, ends = array("i"), [0]
            yield _lists(found, ends)

    return rows.withColumn(to, ids(F.col(text)))


def _lists(values: array, ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32)))


def features(rows: DataFrame, prompt: str, full: str, most: int) -> DataFrame:
    """rows with input_ids, attention_mask and labels; raises where the prompt is no prefix or the row is too long: nothing is cut."""
    p, f = F.col(prompt), F.col(full)
    n = F.size(p)
    fault = F.when(F.slice(f, 1, n) != p, "the prompt's ids are no prefix").when(F.size(f) <= n, "no completion").when(F.size(f) > most, "too long")
    ids = F.when(fault.isNull(), f).otherwise(F.raise_error(fault).cast("array<int>"))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(f, n + 1, F.size(f)))
    return rows.withColumn("input_ids", ids).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(f))).withColumn("labels", labels)


def padded(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """Features padded on the right to the longest row of their batch."""
    gap = F.max(F.size("input_ids")).over(Window.partitionBy(batch)) - F.size("input_ids")
    made = rows.withColumn("_gap", gap)
    for c, v in (("input_ids", pad), ("attention_mask", 0), ("labels", IGNORED)):
        made = made.withColumn(c, F.concat(c, F.array_repeat(F.lit(v), F.col("_gap"))))
    return made.drop("_gap")


def length_limit(longest: int, step: int = 128) -> int:
    """The longest length, up to a multiple of step."""
    return -(-longest // step) * step


def answers(inputs: DataFrame, text: str, generate: Callable[[list[str]], list[str]], to: str = "raw_output", batch: int = 16) -> DataFrame:
    """inputs with what a parser answers. `generate` takes and gives a list of texts; it is loaded once a worker."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        out: list[str] = []
        for at in range(0, len(texts), batch):
            got = generate(list(texts[at : at + batch]))
            if len(got) != len(texts[at : at + batch]):
                raise ValueError("a parser gives one answer for each text")
            out += got
        return pd.Series(out)

    return inputs.withColumn(to, run(F.col(text)))
