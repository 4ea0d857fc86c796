"""Scores of choices, from any scorer or from the words that a choice shares with its question."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quizloom.functions.arrays import answer_text, argmax, first_choices, rejection
from quizloom.operators.profile import TERM
from quizloom.sources.mcq import written


def score_choices(df: DataFrame, scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """id, len_choices, logits. The scorer is made once per task and gets (id, messages, len_choices)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "len_choices": batch["len_choices"], "logits": score(batch)})

    return df.select("id", "messages", "len_choices").mapInPandas(rows, "id string, len_choices int, logits array<double>")


def lexical_scores(mcq: DataFrame) -> DataFrame:
    """id, len_choices, logits, a row per question: for each choice, the sum of its distinct terms' inverse document
    frequencies (documents are all choices) over the terms that the paragraph or question has too.

    Questions are told apart by a key of their own, so those of one id don't meet, and those without choices stay, with no
    logits. They are written once with what their choices share with them; only these terms and their frequencies pass
    an exchange. A null choice has no terms.
    """
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0)))
    rows = mcq.select("id", F.size("choices").alias("len_choices"), F.transform(F.coalesce("choices", F.array().cast("array<string>")), terms).alias("terms"), terms(F.concat_ws(" ", "paragraph", "question")).alias("context"))
    hits = F.flatten(F.transform("terms", lambda t, k: F.transform(F.array_intersect(t, F.col("context")), lambda x: F.struct(k.alias("k"), x.alias("term")))))
    seen = Observation()
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "len_choices", F.size("terms").alias("choices"), F.flatten("terms").alias("terms"), hits.alias("hits"))
    rows = written(rows.observe(seen, F.sum("choices").alias("n")), "questions")
    n = seen.get["n"] or 0
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    found = rows.select("row", F.explode("hits").alias("h")).select("row", "h.k", "h.term").join(df, "term")
    weight = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    # A question's hits are no more than its own terms.
    found = found.groupBy("row").agg(F.collect_list(F.struct("k", weight.alias("w"))).alias("found"))
    sums = F.transform(
        F.sequence(F.lit(0), F.col("choices") - 1),
        lambda k: F.round(F.aggregate(F.filter("found", lambda h: h["k"] == k), F.lit(0.0), lambda a, h: a + h["w"]), 9),
    )
    logits = F.when(F.col("found").isNull(), F.array_repeat(F.lit(0.0), F.col("choices"))).otherwise(sums)
    return rows.join(found, "row", "left").select("id", "len_choices", logits.alias("logits"))


def predictions(scores: DataFrame) -> DataFrame:
    """id, answer from id, len_choices, logits; the first choice on ties."""
    best: Column = argmax(first_choices(F.col("logits"), F.greatest(F.col("len_choices"), F.lit(0))))
    return scores.select("id", answer_text(best, F.col("len_choices")).alias("answer"))


def rejected(scores: DataFrame) -> DataFrame:
    """id, reason of the rows of id, len_choices, logits that get no answer."""
    best = argmax(first_choices(F.col("logits"), F.greatest(F.col("len_choices"), F.lit(0))))
    return scores.select("id", rejection(best, F.col("len_choices")).alias("reason")).where("reason is not null")


def unanswered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions without an answer."""
    return questions.join(answers.where("answer is not null"), "id", "left_anti")
