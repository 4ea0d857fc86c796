"""Seeded order, exact splits and batches, without sorting everything in one task."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a hash prefix is to have, and the longest prefix: its 16 ** 5 offsets are broadcast.
PREFIX_ROWS, DIGITS = 4096, 5


def prefix_digits(n: int) -> int:
    """Hex digits that leave PREFIX_ROWS rows to a prefix, or fewer digits than that takes."""
    return next((d for d in range(1, DIGITS) if n <= PREFIX_ROWS * 16**d), DIGITS)


def seeded_index(df: DataFrame, id_col: str, seed: int | str = 42, digits: int | None = None) -> DataFrame:
    """df with row_index: place in the order of md5('seed:id'), then id.

    Rows are numbered inside each hash prefix only, of as many digits as their number asks for; the
    prefixes' offsets are accumulated and broadcast.
    """
    digits = prefix_digits(df.count()) if digits is None else digits
    hashed = df.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")))
    hashed = hashed.withColumn("__prefix", F.substring("__hash", 1, digits))
    sizes = hashed.groupBy("__prefix").count()
    before = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__prefix", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__prefix").orderBy("__hash", id_col)
    out = hashed.join(F.broadcast(offsets), "__prefix").withColumn("row_index", F.col("__offset") + F.row_number().over(inside) - 1)
    return out.drop("__hash", "__prefix", "__offset")


def test_size(n: int, share: float) -> int:
    """ceil(n * share), as in decimal arithmetic."""
    return math.ceil(n * Fraction(str(share)))


def split_column(df: DataFrame, id_col: str, share: float = 0.1, seed: int | str = 42) -> DataFrame:
    """df with split, 'test' for the first rows in seeded order and 'train' for the others."""
    n = df.count()
    first = test_size(n, share)
    return seeded_index(df, id_col, seed, prefix_digits(n)).withColumn("split", F.when(F.col("row_index") < first, "test").otherwise("train")).drop("row_index")


def train_test_split(df: DataFrame, id_col: str, share: float = 0.1, seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    both = split_column(df, id_col, share, seed)
    return tuple(both.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def pad_batches(df: DataFrame, id_col: str, size: int = 1, pad: int = 2, ids_col: str = "input_ids", labels_col: str | None = None, seed: int | str = 42) -> DataFrame:
    """df with batch; ids (and labels, with -100) padded on the right to the batch's longest."""
    rows = seeded_index(df, id_col, seed).withColumn("batch", F.floor(F.col("row_index") / size)).drop("row_index")
    longest = F.max(F.size(ids_col)).over(Window.partitionBy("batch"))
    rows = rows.withColumn("__short", longest - F.size(ids_col))
    rows = rows.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)), F.array_repeat(F.lit(0), F.col("__short"))))
    rows = rows.withColumn(ids_col, F.concat(ids_col, F.array_repeat(F.lit(pad), F.col("__short"))))
    if labels_col:
        rows = rows.withColumn(labels_col, F.concat(labels_col, F.array_repeat(F.lit(-100), F.col("__short"))))
    return rows.drop("__short")
