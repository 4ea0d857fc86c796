"""Whole jobs, each one lazy plan but for a count, a bounded vocabulary or a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quizloom.functions import arrays, text
from quizloom.operators import metrics, profile, runs, score, split, tokens
from quizloom.sources import mcq as source
from quizloom.sources.reuse import reused


def training_examples(mcq: DataFrame) -> DataFrame:
    """id, messages, label of questions with an answer."""
    user = text.prompt(F.col("paragraph"), F.col("question"), F.col("choices"), F.col("question_plus"))
    return mcq.where(F.col("answer").isNotNull()).select("id", text.training_messages(user, F.col("answer")).alias("messages"), F.col("answer").cast("int").alias("label"))


def inference_examples(mcq: DataFrame) -> DataFrame:
    """id, messages, len_choices of every question."""
    user = text.prompt(F.col("paragraph"), F.col("question"), F.col("choices"), F.col("question_plus"))
    return mcq.select("id", text.inference_messages(user).alias("messages"), F.size("choices").alias("len_choices"))


def tokenized(chats: DataFrame, text_col: str, tokenizer: tokens.WordTokenizer | tokens.FileTokenizer, keep: tuple[str, ...], reuse: bool = True) -> DataFrame:
    """The kept columns, input_ids and attention_mask of chats, written; with reuse, a table that was made of the
    same files with the same tokenizer by the same code is read instead of encoding again."""

    def make() -> DataFrame:
        ids = chats.withColumn("input_ids", tokenizer.encode(F.col(text_col)))
        return ids.select(*keep, "input_ids", arrays.attention_mask(F.col("input_ids")).alias("attention_mask"))

    if not reuse:
        return source.written(make(), "tokens")
    return reused(make, "tokens", [chats], {"tokenizer": tokenizer.digest(), "text": text_col, "keep": keep}, [tokens, arrays])


def training_data(
    mcq: DataFrame, max_length: int = 1024, share: float = 0.1, seed: int = 42, max_vocab: int = 10_000, template: Callable = text.turn_template,
    tokenizer: tokens.WordTokenizer | tokens.FileTokenizer | None = None, response: str = text.RESPONSE, reuse: bool = False,
) -> DataFrame:
    """id, input_ids, attention_mask, labels, split.

    Without a tokenizer a word vocabulary of the chats is made. Labels begin after the last place where the response's
    ids stand, as the tokenizer encodes it by itself.
    """
    chats = training_examples(mcq).select("id", template(F.col("messages")).alias("chat"))
    if tokenizer is None:
        tokenizer = tokens.WordTokenizer(source.written(tokens.build_vocabulary(chats, "chat", max_vocab), "vocabulary"))
    # Written, as the labels, the split's size and its order are all made from them.
    rows = tokens.filter_by_length(tokenized(chats, "chat", tokenizer, ("id",), reuse), max_length)
    opening = tokenizer.ids(response)
    if not opening:
        raise ValueError("the response has no tokens")
    labels = arrays.completion_mask(F.col("input_ids"), F.array(*(F.lit(i).cast("int") for i in opening)), len(opening), F.lit(arrays.IGNORED))
    return split.split_column(rows.withColumn("labels", labels), "id", share, seed)


def staged(raw: DataFrame, share: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The questions of raw that can be read, with split, and how many rows came to each stage: stage, n.

    Stages are counted while rows are written, not by counting again; the split goes over the written ids alone.
    """
    read, kept = Observation(), Observation()
    flat = source.flatten(raw.observe(read, F.count(F.lit(1)).alias("raw"))).where("error is null").drop("error")
    flat = source.written(flat.observe(kept, F.count(F.lit(1)).alias("flattened")), "flattened")
    n = read.get | kept.get
    test = split.test_size(n["flattened"], share)
    rows = [*n.items(), ("test", test), ("train", n["flattened"] - test)]
    return split.split_column(flat, "id", share, seed), raw.sparkSession.createDataFrame(rows, "stage string, n long")


def answers(mcq: DataFrame, scorer: Callable | None = None) -> DataFrame:
    """id, answer; without a scorer, by shared words."""
    return score.predictions(score.score_choices(inference_examples(mcq), scorer) if scorer else score.lexical_scores(mcq))


def submit(mcq: DataFrame, root: str, scorer_of: Callable[[str], Callable | None], artifacts: DataFrame | None = None, checkpoint: str | None = None) -> tuple[str, DataFrame]:
    """Answers the questions with the scorer of one checkpoint, the latest of artifacts (name) unless one is given, and
    writes them as that checkpoint's run under root; other runs' answers stay. Returns the run and its answers as written.

    A checkpoint may be a path; its last part is the run. Without any numbered artifact FileNotFoundError is raised.
    """
    if checkpoint is None:
        if artifacts is None:
            raise ValueError("neither a checkpoint nor artifacts to choose the latest of")
        checkpoint = runs.require_latest(artifacts)
    run = checkpoint.rstrip("/").rpartition("/")[2]
    made = answers(mcq, scorer_of(checkpoint)).withColumn("run", F.lit(run))
    return run, source.write_submissions(made, root).where(F.col("run") == run)


def evaluation(truth: DataFrame, predicted: DataFrame, given: dict[str, metrics.Metric] | None = None) -> DataFrame:
    """accuracy, macro_f1, n, n_classes, or the given metrics: truth (id, answer) joined by id with predicted (id, answer)."""
    pairs = truth.select("id", F.col("answer").cast("string").alias("y")).join(predicted.select("id", F.col("answer").alias("p")), "id")
    return metrics.evaluation(pairs, given)


def evaluate_logits(rows: DataFrame, vocabulary: list[str], answer_offset: int = -2, given: dict[str, metrics.Metric] | None = None) -> DataFrame:
    """Metrics of a model's output: rows have sequence (logits of each position over the vocabulary) and labels (ids, -100 ignored).

    The prediction is the most probable of the answers' tokens at one position, the truth what the labels say; an answer that isn't in
    the vocabulary has the logit of id 0, labels that say none are the first class. Both are in a row, so nothing is joined.
    """
    at = {piece: i for i, piece in reversed(list(enumerate(vocabulary)))}
    ids = F.array(*(F.lit(at.get(str(k), 0)) for k in range(1, 6)))
    p = arrays.argmax(arrays.softmax(arrays.answer_logits(F.col("sequence"), ids, answer_offset)))
    y = metrics.decoded_ids(F.col("labels"), F.array(*map(F.lit, vocabulary)))
    return metrics.evaluation(rows.select(y.alias("y"), p.alias("p")), given)


def profiling(mcq: DataFrame, bins: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missing values, length histogram, TF-IDF weights of the full questions."""
    full = mcq.select("id", text.full_question(F.col("question"), F.col("question_plus")).alias("full_question"))
    lengths = full.withColumn("question_length", F.length("full_question"))
    return profile.missing_values(mcq), profile.histogram(lengths, "question_length", bins), profile.tfidf(full, "id", "full_question")


def question_profile(mcq: DataFrame) -> DataFrame:
    """The profile as rows kind, key, value: missing values by column, question lengths by bin, terms by total weight."""
    missing, lengths, weights = profiling(mcq)
    row = lambda kind, key, value: (F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), value.cast("double").alias("value"))
    terms = weights.groupBy("term").agg(F.sum("weight").alias("weight"))
    return missing.select(*row("missing", "column", F.col("n_missing"))).unionByName(lengths.select(*row("length", "bin", F.col("n")))).unionByName(terms.select(*row("term", "term", F.col("weight"))))


def run_comparison(log: DataFrame, greater_is_better: bool = False) -> DataFrame:
    """run, step, value, n_improvements."""
    return runs.improvements(log, greater_is_better)


def best_records(logs: DataFrame, path: str, metric_name: str, greater_is_better: bool = False) -> DataFrame:
    """From metric logs (JSON blocks) to a record of each run's best under path; returns what was written.

    Runs are the logs' names. Entries without a step or a value are passed over; of the entries of a step the later
    by time comes later. The log is read once.
    """
    log = source.metric_rows(logs).where("step is not null and value is not null")
    best = runs.improvements(log.select(F.col("name").alias("run"), F.struct("step", "timestamp").alias("step"), "value"), greater_is_better)
    source.write_best(best.select("run", "step.step", "value"), path, metric_name)
    return logs.sparkSession.read.schema("run string, original_checkpoint string, step long, metric double, metric_name string").json(path)
