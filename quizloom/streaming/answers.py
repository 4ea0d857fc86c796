"""Answering a stream of questions. The row-wise columns and a scorer per batch need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quizloom.operators.score import predictions, score_choices
from quizloom.plans.jobs import inference_examples


def answer_stream(questions: DataFrame, scorer: Callable, path: str, checkpoint: str) -> StreamingQuery:
    """Writes (id, answer) as Parquet for all that is there when it starts, once each."""
    answers = predictions(score_choices(inference_examples(questions), scorer))
    return answers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
