"""Decoding of labels, accuracy, confusion and macro-F1. Frames have y (truth) and p (prediction)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions.arrays import IGNORED, class_of
from quizloom.functions.text import TURN_END


def decoded_text(tokens: Column) -> Column:
    """What the label tokens say before the turn's end; white space of any kind is trimmed."""
    text = F.element_at(F.split(F.array_join(tokens, ""), TURN_END), 1)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def decoded_class(labels: Column, ignored: Column, default: int | None = 0) -> Column:
    return class_of(decoded_text(F.filter(labels, lambda x: x != ignored)), default)


def decoded_ids(labels: Column, pieces: Column, ignored: int = IGNORED, default: int | None = 0) -> Column:
    """The class of label ids; pieces: the tokenizer's texts by id, from 0. Ignored and unknown ids say nothing."""
    texts = F.transform(F.filter(labels, lambda i: i != ignored), lambda i: F.coalesce(F.try_element_at(pieces, i + 1), F.lit("")))
    return class_of(decoded_text(texts), default)


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y", "p").agg(F.count("*").alias("n"))


def class_f1(df: DataFrame) -> DataFrame:
    """class, support, predicted, tp, f1; classes are those seen in y or p."""
    return _class_f1(confusion(df))


def _class_f1(cells: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))))
    hit = F.when((F.col("y") == F.col("p")) & (F.col("c.support") > 0), F.col("n")).otherwise(0)
    out = cells.select("y", "p", "n", pairs.alias("c")).select("c.class", "c.support", "c.predicted", hit.alias("tp"))
    out = out.where(F.col("class").isNotNull()).groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp")))
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)))


Metric = Callable[[Column], Column]


def cells_where(cells: Column, test: Callable[[Column], Column]) -> Column:
    """How many rows are in the cells (y, p, n) of a confusion table that pass a test."""
    return F.aggregate(F.filter(cells, test), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def classes_of(cells: Column) -> Column:
    """All values of y or p but null, once each."""
    return F.filter(F.array_union(cells["y"], cells["p"]), lambda c: c.isNotNull())


def accuracy_of(cells: Column) -> Column:
    """Pairs that lack y or p don't count."""
    return F.try_divide(cells_where(cells, lambda x: x["y"] == x["p"]).cast("double"), cells_where(cells, lambda x: x["y"].isNotNull() & x["p"].isNotNull()))


def macro_f1_of(cells: Column) -> Column:
    """Each class's F1 counts alike; one that is never both true and predicted has 0."""
    hit = lambda c: cells_where(cells, lambda x: (x["y"] == c) & (x["p"] == c))
    both = lambda c: cells_where(cells, lambda x: x["y"] == c) + cells_where(cells, lambda x: x["p"] == c)
    f1 = F.transform(classes_of(cells), lambda c: F.coalesce(F.try_divide(2.0 * hit(c), both(c)), F.lit(0.0)))
    return F.try_divide(F.aggregate(f1, F.lit(0.0), lambda a, x: a + x), F.size(f1))


def count_of(cells: Column) -> Column:
    return cells_where(cells, lambda x: F.lit(True))


def class_count_of(cells: Column) -> Column:
    return F.size(classes_of(cells)).cast("long")


METRICS: dict[str, Metric] = {"accuracy": accuracy_of, "macro_f1": macro_f1_of, "n": count_of, "n_classes": class_count_of}


def evaluation(df: DataFrame, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """A row with a column per metric, all from one confusion table, which has a row per pair of classes.

    A metric makes a column from the table's cells, an array of structs y, p, n; METRICS unless given.
    """
    cells = confusion(df).groupBy().agg(F.collect_list(F.struct("y", "p", "n")).alias("cells"))  # as many as pairs of classes
    return cells.select(*(made(F.col("cells")).alias(name) for name, made in (METRICS if metrics is None else metrics).items()))


def macro_f1(df: DataFrame) -> DataFrame:
    return class_f1(df).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))
