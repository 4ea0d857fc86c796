"""A training corpus from `documents`: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last returns packed pieces. A stage's result is for its caller to write: it is read once, and the
tables that it reads are removed when the next stage begins with other rows. Stages leave the session's Arrow batches
small, as texts are long. Nulls, repeats and extra columns: see the operators.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import mixing, ngram_join, packing, quality, queries, substring
from quizloom.llm.common import id_table, materialise, may_hold, remove, small_batches, tables

#: Mixing takes this share of the tokens, in one epoch: no document is repeated.
MIX_SHARE = 0.9


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that an application's last stage left.
_left: dict[str, list[str]] = {}


def staged(work: Stage) -> Stage:
    """A stage that removes what the one before it left, unless its own rows are still read from there."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        app = spark.sparkContext.applicationId
        old, files = _left.pop(app, []), "\n".join(docs.inputFiles())
        used = [path for path in old if path.rpartition("/")[2] in files]
        remove(spark, [path for path in old if path not in used])
        with tables() as own:
            out = work(spark, docs, sf_dir)
        _left[app] = used + own
        return out

    return stage


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=quality.learnable())
    return quality.with_score(docs, model, score_col="__score").where(F.col("__score") >= 0.7).select(*docs.columns)


@staged
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more.

    Rows that repeat an id are one document, of which the first row by text, then by all columns as
    JSON, stays; rows without an id all stay.
    """
    classes = ngram_join.jaccard_classes(docs, k=5, percent=80).where("doc_id is not null")
    copies = F.max(F.col("component_id") != F.col("doc_id")).alias("copy")
    touched = materialise(classes.groupBy("doc_id").agg(copies, F.count("*").alias("n")).where("copy or n > 1"), "touched")
    # Only rows that may go pass the exchanges.
    touch = may_hold(id_table(touched, "doc_id"), "doc_id")
    some = materialise(docs.where(touch & F.col("doc_id").isNotNull()), "some")
    some = some.join(touched.where("copy"), "doc_id", "left_anti")
    row = F.struct(*docs.columns)
    one = some.join(touched.where("not copy"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row).alias("row"))).alias("row"))
    rest = some.join(touched.where("not copy"), "doc_id", "left_anti").select(*docs.columns)
    return docs.where(~touch | F.col("doc_id").isNull()).unionByName(rest).unionByName(one.select("row.*"))


@staged
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word passages of earlier ones; those with no other words go."""
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("__others")  # whatever their names
    out = substring.remove_repeats(docs.select("doc_id", "text", others)).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    own = {c: F.col(f"__others.`{c}`") for c in docs.columns if c != "text"}
    own |= {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(own["n_chars"])}
    return out.select(*(own[c].alias(c) for c in docs.columns))


@staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix to the target weights takes, whole if it takes a part.

    The mix decides on each row by itself, also on rows that have no id or repeat one; equal rows go
    together. A text without words has no tokens to take: it stays where the mix takes all of its leaf,
    and goes elsewhere.
    """
    return mixing.taken(docs, queries.domain(), MIX_SHARE, 1, queries.WEIGHTS, seed="7")


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and its place there."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, tokenizer and packing can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written once, and removed when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with tables() as own:
            docs = materialise(stage(spark, docs, sf_dir), name)
        remove(spark, before)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
