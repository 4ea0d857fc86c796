"""Registered queries over the given tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions import arrays, literal, text
from quizloom.operators import metrics, profile, runs, score, split, tokens
from quizloom.plans import jobs
from quizloom.sources import mcq as source
from quizloom.streaming.answers import answer_stream

QUESTION = "Which nation is the customer's?"
TERMS, VOCABULARY, LENGTH, BATCH = 1000, 2000, 250, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer parts than there are cores over all cores, as much is done with each; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from customers: which of their region's five nations is theirs? There are 25 nations."""
    nations = table(spark, sf_dir, "nation")
    regions = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("all"))
    nations = nations.join(regions, "n_regionkey")
    rows = spread(table(spark, sf_dir, "customer")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat("c_name", F.lit(" lives in "), "n_name").alias("paragraph"),
        F.lit(QUESTION).alias("question"),
        F.col("all.n_name").alias("choices"),
        F.array_position(F.col("all.n_nationkey"), F.col("n_nationkey")).cast("int").alias("answer"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("question_plus"),
    )


def raw_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions as (id, paragraph, problems), problems being a literal; None where there is no more to the question."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    choices = F.array_join(F.transform("choices", quoted), ", ")
    plus = F.coalesce(quoted(F.col("question_plus")), F.lit("None"))
    problems = F.concat(F.lit('{\'question\': "'), "question", F.lit('", \'choices\': ['), choices, F.lit("], 'answer': "), F.col("answer").cast("string"), F.lit(", 'question_plus': "), plus, F.lit("}"))
    return mcq(spark, sf_dir).select("id", "paragraph", problems.alias("problems"))


def joined(c: str | Column, by: str = "|") -> Column:
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("~"))), by)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, chat: conversations rendered in the order of their turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias("messages")).select("conv_id", text.turn_template(F.col("messages")).alias("chat"))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return tokens.tokenize(docs, "text", tokens.encoder(tokens.build_vocabulary(docs, "text", VOCABULARY)), ("doc_id",))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, logits (five of the 64), len_choices 1 to 5."""
    five = arrays.gather(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, (3, 1, 4, 15, 9))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", five.alias("logits"), (F.col("vec_id") % 5 + 1).cast("int").alias("len_choices"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("p"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("name"), "value", F.col("event_id").alias("step"), stamp.alias("timestamp"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("checkpoint-"), F.when(F.col("o_orderkey") % 7 == 0, "best").otherwise(F.col("o_orderkey").cast("string"))).alias("name"))


def scan_mcq_csv(spark, sf_dir):
    path = source.scratch(spark, "mcq")
    source.write_csv(raw_mcq(spark, sf_dir), path)
    return source.read_mcq(spark, path)


def flatten_mcq(spark, sf_dir):
    flat = source.flatten(raw_mcq(spark, sf_dir))
    return flat.select("id", "paragraph", "question", joined("choices").alias("choices"), "answer", "question_plus", "error")


def parse_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", literal.literal_json("props").alias("l"))
    return rows.select("event_id", F.from_json("l.json", "k int")["k"].alias("k"), F.col("l.error").alias("error"))


def stage_counts(spark, sf_dir):
    return jobs.staged(raw_mcq(spark, sf_dir))[1].where("stage <> 'raw'")


def staged_questions(spark, sf_dir):
    return jobs.staged(raw_mcq(spark, sf_dir))[0].select("id", "answer", "split")


def submission(spark, sf_dir):
    return source.write_submission(jobs.answers(mcq(spark, sf_dir)), source.scratch(spark, "submission"))


def submission_runs(spark, sf_dir):
    """Three runs' answers, written by two calls; the second replaces one run's and adds another."""
    questions, root = mcq(spark, sf_dir), source.scratch(spark, "runs")
    of = lambda run, answer: questions.select("id", F.lit(answer).alias("answer"), F.lit(run).alias("run"))
    source.write_submissions(of("checkpoint-1000", "1").unionByName(of("best_model", "2")), root)
    return source.write_submissions(of("checkpoint-1000", "3").unionByName(of("checkpoint-2000", "4")), root)


def lexical_scores(spark, sf_dir):
    """Questions of which some have no choices, and two of which share an id each."""
    key = F.col("id").cast("long")
    choices = F.when(key % 7 == 1, F.array().cast("array<string>")).when(key % 7 != 0, F.col("choices"))
    rows = mcq(spark, sf_dir).select(F.expr("id div 2").cast("string").alias("id"), "paragraph", "question", choices.alias("choices"))
    return score.lexical_scores(rows).select("id", "len_choices", F.array_join(F.transform("logits", lambda x: F.format_string("%.6f", x)), "|").alias("logits"))


def metric_log_json(spark, sf_dir):
    """Each block of a metric's JSON series, its entries printed in a fixed form."""
    series = source.metric_series(metric_log(spark, sf_dir))
    blocks = series.select("name", "block", F.explode(F.from_json("json", source.LOG)).alias("of", "entries"))
    entry = lambda e: F.concat_ws(" ", F.coalesce(F.format_string("%.6f", e["value"]), F.lit("~")), e["step"].cast("string"), e["timestamp"])
    return blocks.where("of = name").select("name", "block", F.size("entries").alias("n"), F.array_join(F.transform("entries", entry), "|").alias("entries"))


def metric_log_long(spark, sf_dir):
    return source.metric_rows(source.metric_series(metric_log(spark, sf_dir)))


def log_levels(spark, sf_dir):
    level = F.when(F.col("value") > 100, "WARNING").when(F.col("value").isNull(), "ERROR").otherwise("INFO")
    return runs.levels(table(spark, sf_dir, "events").select(level.alias("level")))


def log_entries(spark, sf_dir):
    """Messages with their level (INFO where none is given), appended to a log in two calls and read back."""
    rows, path = table(spark, sf_dir, "events"), source.scratch(spark, "messages")
    level = F.when(F.col("value") > 100, "WARNING")
    entry = runs.log_entry(F.concat(F.lit("event "), F.col("event_id").cast("string")), level, F.col("ts"))
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        source.append_log(rows.where(part).select(entry.alias("e")).select("e.*"), path)
    return spark.read.schema("timestamp string, level string, message string").json(path)


def run_names(spark, sf_dir):
    """The default name that a run begun at each order's or event's time has, and that time in a log."""
    times = table(spark, sf_dir, "events").select("ts").unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts")))
    return times.select(runs.run_name(F.col("ts")).alias("name"), runs.iso_stamp(F.col("ts")).alias("stamp")).groupBy("name", "stamp").agg(F.count("*").alias("n"))


def best_checkpoint(spark, sf_dir):
    return jobs.run_comparison(log(spark, sf_dir))


def running_best(spark, sf_dir):
    return runs.running_best(log(spark, sf_dir), greater_is_better=True)


def running_best_stamps(spark, sf_dir):
    """Steps as far apart as stamps in nanoseconds, some of them negative."""
    stamp = ((F.col("step") % 1000 - 500) * 10**15 + F.col("step")).alias("step")
    return runs.running_best(log(spark, sf_dir).select("run", stamp, "value"))


def best_records(spark, sf_dir):
    """From the log's JSON blocks to the record of each metric's best, as it is written."""
    series = source.metric_series(metric_log(spark, sf_dir))
    return jobs.best_records(series, source.scratch(spark, "best"), "eval_loss")


def latest_checkpoint(spark, sf_dir):
    return runs.latest_artifact(artifacts(spark, sf_dir))


def checkpoint_order(spark, sf_dir):
    return runs.ordered_artifacts(artifacts(spark, sf_dir))


def question_length(spark, sf_dir):
    rows = mcq(spark, sf_dir).select("id", text.full_question(F.col("question"), F.col("question_plus")).alias("full_question"))
    return rows.withColumn("question_length", F.length("full_question"))


def missing_values(spark, sf_dir):
    return profile.missing_values(mcq(spark, sf_dir))


def length_histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n").select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def tfidf_vocab(spark, sf_dir):
    return profile.tfidf_vocabulary(spread(table(spark, sf_dir, "documents")), "doc_id", "text", TERMS)


def tfidf_weights(spark, sf_dir):
    return profile.tfidf(spread(table(spark, sf_dir, "documents")), "doc_id", "text", TERMS).select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def tfidf_wide(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    top, counts = profile.frequent_counts(docs, "doc_id", "text", 20)
    terms = [r["term"] for r in top.collect()]
    wide = profile.tfidf_wide(profile.weighted(counts, docs.count()), terms, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
    values = F.array(*(F.round(F.col(f"`{t}`"), 6) for t in sorted(terms)))
    return wide.select(F.col("id").alias("doc_id"), F.array_join(F.transform(values, lambda x: F.format_string("%.6f", x)), "|").alias("weights"))


def tfidf_head(spark, sf_dir):
    """The preview: the 20 rows of the smallest ids and terms."""
    return tfidf_weights(spark, sf_dir).orderBy("doc_id", "term").limit(20)


def numbered_choices(spark, sf_dir):
    return mcq(spark, sf_dir).select("id", text.numbered_choices(F.col("choices")).alias("choices"))


def create_prompt(spark, sf_dir):
    return mcq(spark, sf_dir).select("id", text.prompt(F.col("paragraph"), F.col("question"), F.col("choices"), F.col("question_plus")).alias("prompt"))


def training_messages(spark, sf_dir):
    rows = jobs.training_examples(mcq(spark, sf_dir))
    return rows.select("id", joined(F.col("messages")["role"]).alias("roles"), joined(F.col("messages")["content"]).alias("contents"), "label")


def inference_messages(spark, sf_dir):
    rows = jobs.inference_examples(mcq(spark, sf_dir))
    return rows.select("id", joined(F.col("messages")["role"]).alias("roles"), joined(F.col("messages")["content"]).alias("contents"), "len_choices")


def render_chat(spark, sf_dir):
    return chats(spark, sf_dir)


def render_inference(spark, sf_dir):
    """The chat up to the model's turn, by the template that the model's name chooses."""
    template = text.choose_template(None, "Gemma-2-it", lambda messages, **_: F.lit("another template"))
    return jobs.inference_examples(mcq(spark, sf_dir)).select("id", template(F.col("messages"), add_generation_prompt=True).alias("chat"))


def build_vocab(spark, sf_dir):
    return tokens.build_vocabulary(spread(table(spark, sf_dir, "documents")), "text", VOCABULARY)


def tokenize_docs(spark, sf_dir):
    return encoded(spark, sf_dir).select("doc_id", joined("input_ids", " ").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"))


def tokenize_reused(spark, sf_dir):
    """The second of two builds of one table, which finds the first's."""
    docs = spread(table(spark, sf_dir, "documents"))
    words = tokens.WordTokenizer(tokens.build_vocabulary(docs, "text", VOCABULARY))
    for _ in range(2):
        rows = jobs.tokenized(docs.select("doc_id", "text"), "text", words, ("doc_id",))
    return rows.select("doc_id", joined("input_ids", " ").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"))


def filter_by_length(spark, sf_dir):
    return tokens.filter_by_length(encoded(spark, sf_dir), LENGTH).select("doc_id", F.size("input_ids").alias("n"))


def completion_mask(spark, sf_dir):
    opening = F.array(F.lit("<start_of_turn>"), F.lit("model"))
    rows = chats(spark, sf_dir).select("conv_id", tokens.tokens(F.col("chat")).alias("t"))
    return rows.select("conv_id", joined(arrays.completion_mask(F.col("t"), opening, 2, F.lit("-100")), " ").alias("labels"))


def decode_labels(spark, sf_dir):
    chat = jobs.training_examples(mcq(spark, sf_dir)).select("id", tokens.tokens(text.turn_template(F.col("messages"))).alias("t"))
    labels = arrays.completion_mask(F.col("t"), F.array(F.lit("<start_of_turn>"), F.lit("model")), 2, F.lit("-100"))
    return chat.select("id", metrics.decoded_class(labels, F.lit("-100")).alias("class"))


def train_test_split(spark, sf_dir):
    return split.split_column(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def pad_batches(spark, sf_dir):
    rows = split.pad_batches(encoded(spark, sf_dir), "doc_id", BATCH, pad=2)
    return rows.select("doc_id", "batch", F.size("input_ids").alias("padded"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"))


def training_data(spark, sf_dir):
    rows = jobs.training_data(mcq(spark, sf_dir))
    return rows.select("id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_labels"), "split")


def training_data_bpe(spark, sf_dir):
    """The training build with a tokenizer from a file."""
    import public_tokenizers

    rows = jobs.training_data(mcq(spark, sf_dir), tokenizer=tokens.FileTokenizer(public_tokenizers.path("word_bpe_49k.json")))
    return rows.select("id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_labels"), "split")


def gather_logits(spark, sf_dir):
    return logits(spark, sf_dir).select("vec_id", F.transform("logits", lambda x: F.format_string("%.6f", x)).alias("l")).select("vec_id", F.array_join("l", "|").alias("logits"))


def choice_softmax(spark, sf_dir):
    rows = logits(spark, sf_dir).select("vec_id", F.posexplode(arrays.softmax(F.col("logits"))).alias("k", "p"))
    return rows.select("vec_id", "k", F.round("p", 6).alias("p"))


def choice_argmax(spark, sf_dir):
    return score.predictions(logits(spark, sf_dir).withColumnRenamed("vec_id", "id"))


def predict_choice(spark, sf_dir):
    return jobs.answers(mcq(spark, sf_dir))


def by_id() -> Callable:
    """A scorer that prefers the choice after the id's remainder by five."""
    return lambda batch: batch["id"].map(lambda i: [float(k == int(i) % 5) for k in range(5)])


def scored_choices(spark, sf_dir):
    """Answers of a scorer over batches of messages."""
    return jobs.answers(mcq(spark, sf_dir), by_id)


def submit_latest(spark, sf_dir):
    """The latest checkpoint's answers, written after another's and read back with the run's name."""
    questions, root = mcq(spark, sf_dir), source.scratch(spark, "runs")
    jobs.submit(questions, root, lambda _: by_id, checkpoint="out/best_model/")
    jobs.submit(questions, root, lambda _: by_id, artifacts(spark, sf_dir))
    return source.read_submissions(spark, root)


def stream_answers(spark, sf_dir):
    """The same from the questions as a stream."""
    path, out, state = (source.scratch(spark, name) for name in ("questions", "answers", "state"))
    questions = mcq(spark, sf_dir)
    questions.write.parquet(path)
    answer_stream(spark.readStream.schema(questions.schema).parquet(path), by_id, out, state).awaitTermination()
    return spark.read.schema("id string, answer string").parquet(out)


def unanswered_questions(spark, sf_dir):
    """Those of vectors with one to seven choices, or none, that get no answer."""
    rows = logits(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 8).cast("int").alias("len_choices"), "logits")
    return score.unanswered(rows.select("id", "len_choices"), score.predictions(rows))


def evaluate_answers(spark, sf_dir):
    questions = mcq(spark, sf_dir)
    out = jobs.evaluation(questions, jobs.answers(questions))
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n", "n_classes")


#: A vocabulary of eight; the answers' ids are 3, 1, 4, 5, 2.
PIECES = ["<pad>", "2", "5", "1", "3", "4", "\n", text.TURN_END]


def logits_evaluation(spark, sf_dir):
    """Each vector as eight positions over eight pieces; labels say the vector's label, some of them nothing."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    ignored = F.array_repeat(F.lit(arrays.IGNORED), 5)
    said = F.array(F.element_at(F.array(*map(F.lit, (3, 1, 4, 5, 2))), (F.col("label") % 5 + 1).cast("int")), F.lit(7), F.lit(6))
    labels = F.when(F.col("label") < 9, F.concat(ignored, said)).otherwise(ignored)
    out = jobs.evaluate_logits(table(spark, sf_dir, "embeddings").select(steps.alias("sequence"), labels.alias("labels")), PIECES)
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "n", "n_classes")


def kappa(cells: Column) -> Column:
    """Agreement beyond chance (Cohen), a caller's own metric."""
    n = metrics.cells_where(cells, lambda x: x["y"].isNotNull() & x["p"].isNotNull())
    share = lambda k: F.try_divide(k.cast("double"), n)
    seen = share(metrics.cells_where(cells, lambda x: x["y"] == x["p"]))
    side = lambda c, of: share(metrics.cells_where(cells, lambda x: (x[of] == c) & x["y"].isNotNull() & x["p"].isNotNull()))
    chance = F.aggregate(F.transform(metrics.classes_of(cells), lambda c: side(c, "y") * side(c, "p")), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(seen - chance, 1 - chance)


def evaluate_metrics(spark, sf_dir):
    """Given metrics and a caller's from one confusion table."""
    out = metrics.evaluation(graded(spark, sf_dir), {"accuracy": metrics.accuracy_of, "macro_f1": metrics.macro_f1_of, "kappa": kappa})
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def accuracy(spark, sf_dir):
    return metrics.accuracy(graded(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"), "n")


def macro_f1(spark, sf_dir):
    return metrics.macro_f1(graded(spark, sf_dir)).select(F.round("macro_f1", 6).alias("macro_f1"), "n_classes")


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(graded(spark, sf_dir))


def question_profile(spark, sf_dir):
    return jobs.question_profile(mcq(spark, sf_dir)).select("kind", "key", F.round("value", 4).alias("value"))


def rejected_answers(spark, sf_dir):
    """Questions of one to seven choices; those of more than five, or of none, are rejected."""
    rows = logits(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 8).cast("int").alias("len_choices"), "logits")
    return score.rejected(rows)


def eval_logits(spark, sf_dir):
    """Each vector as a sequence of eight positions over a vocabulary of eight: the logits before the last one."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    five = arrays.answer_logits(steps, F.array(*map(F.lit, (3, 1, 4, 5, 2))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(five, lambda x: F.format_string("%.6f", x)), "|").alias("logits"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_mcq_csv, flatten_mcq, parse_props, stage_counts, submission, metric_log_json, metric_log_long, log_levels, best_checkpoint, running_best,
        latest_checkpoint, checkpoint_order, question_length, missing_values, length_histogram, tfidf_vocab, tfidf_weights, tfidf_wide, tfidf_head,
        numbered_choices, create_prompt, training_messages, inference_messages, render_chat, build_vocab, tokenize_docs, filter_by_length, completion_mask,
        decode_labels, train_test_split, pad_batches, training_data, gather_logits, choice_softmax, choice_argmax, predict_choice, evaluate_answers,
        accuracy, macro_f1, confusion_matrix, question_profile, rejected_answers, eval_logits,
        log_entries, run_names, render_inference, scored_choices, submit_latest, stream_answers, unanswered_questions,
        staged_questions, submission_runs, lexical_scores, running_best_stamps, best_records, tokenize_reused, training_data_bpe, logits_evaluation, evaluate_metrics,
    )
}

_MCQ = f"""mcq AS (
  SELECT c_custkey::VARCHAR AS id, c_name || ' lives in ' || n.n_name AS paragraph, '{QUESTION.replace("'", "''")}' AS question, r.choices,
         list_position(r.keys, n.n_nationkey)::INTEGER AS answer, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS question_plus
  FROM customer JOIN nation n ON c_nationkey = n.n_nationkey
  JOIN (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS choices, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY ALL) r USING (n_regionkey))"""
_NUMBERED = "array_to_string(list_transform(choices, lambda c, i: i::VARCHAR || ' - ' || c), chr(10))"
_nl = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
_PROMPT = (
    f"{_nl(text.PARAGRAPH_HEAD)} || paragraph || {_nl(text.QUESTION_HEAD)} || question || coalesce({_nl(text.PLUS_HEAD)} || question_plus, '') || "
    f"{_nl(text.CHOICES_HEAD)} || {_NUMBERED} || {_nl(text.ANSWER_HEAD)}"
)
_MODEL_TURN = _nl(f"{text.TURN_END}\n{text.TURN_START}model\n")
_CHATS = f"""chats AS (
  SELECT conv_id, coalesce(any_value(text) FILTER (WHERE nth = 1 AND role = 'system'), '') || coalesce(string_agg(
    CASE role WHEN 'user' THEN {_nl(text.TURN_START + "user" + chr(10))} || coalesce(text, '') || {_MODEL_TURN}
              WHEN 'assistant' THEN coalesce(text, '') || {_nl(text.TURN_END + chr(10))} ELSE '' END, '' ORDER BY nth), '') AS chat
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth FROM conversations) GROUP BY conv_id)"""
_TOKENS = f"regexp_extract_all(coalesce(%s, ''), '{tokens.TOKEN}')"
_MASKED = """list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i <= coalesce(list_max(list_filter(range(1, len(t)), lambda j: t[j] = '<start_of_turn>' AND t[j + 1] = 'model')) + 1, len(t)) THEN '-100' ELSE t[i] END)"""
_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{profile.TERM}')) AS term FROM documents) GROUP BY ALL)"
_VOCAB = "vocab AS (SELECT term, sum(tf)::BIGINT AS ctf, count(*) AS df FROM tf GROUP BY term ORDER BY ctf DESC, term LIMIT {n})"
_WEIGHTS = f"""{_TF}, {_VOCAB}, w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN vocab USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""
_IDS = f"""d AS (SELECT doc_id, {_TOKENS % "text"} AS t FROM documents),
top AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + {len(tokens.SPECIAL) - 1} AS id FROM (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM d)
  WHERE term NOT IN {tokens.SPECIAL} GROUP BY term ORDER BY n DESC, term LIMIT {VOCABULARY})),
vocabulary AS (SELECT term, n, id::INTEGER AS id FROM top UNION ALL VALUES {", ".join(f"('{t}', NULL, {i})" for i, t in enumerate(tokens.SPECIAL))})"""
_ORDER = "row_number() OVER (ORDER BY md5('42:' || {id}), {id}) - 1"
_LOGITS = "l AS (SELECT vec_id, label, [embedding[i + 1]::DOUBLE for i in [3, 1, 4, 15, 9]] AS logits, (vec_id % 5 + 1)::INTEGER AS n FROM embeddings)"
_GRADED = "g AS (SELECT quality AS y, toxic AS p FROM labels)"
_F1 = """f1 AS (SELECT c, coalesce(2.0 * sum((y = c AND p = c)::INTEGER) / nullif(sum((y = c)::INTEGER) + sum((p = c)::INTEGER), 0), 0) AS f1
  FROM g, (SELECT DISTINCT c FROM (SELECT y AS c FROM g UNION SELECT p FROM g) WHERE c IS NOT NULL) GROUP BY c)"""
_TERMS_OF = f"list_distinct(regexp_extract_all(lower(%s), '{profile.TERM}'))"
_ANSWERS = f"""rows_ AS (SELECT id, len(choices) AS n, i - 1 AS k, {_TERMS_OF % "choices[i]"} AS terms, {_TERMS_OF % "paragraph || ' ' || question"} AS context FROM mcq, unnest(range(1, len(choices) + 1)) AS u(i)),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM rows_) GROUP BY term),
hits AS (SELECT id, k, sum(ln((1.0 + (SELECT count(*) FROM rows_)) / (1.0 + df)) + 1.0) AS s FROM (SELECT id, k, unnest(list_intersect(terms, context)) AS term FROM rows_) JOIN df USING (term) GROUP BY ALL),
answers AS (SELECT id, (arg_max(k, (round(coalesce(s, 0), 9), -k)) + 1)::VARCHAR AS answer FROM rows_ LEFT JOIN hits USING (id, k) GROUP BY id)"""
_LOG = "log AS (SELECT event_type AS run, event_id AS step, value FROM events)"
_ARTIFACTS = "artifacts AS (SELECT 'checkpoint-' || CASE WHEN o_orderkey % 7 = 0 THEN 'best' ELSE o_orderkey::VARCHAR END AS name FROM orders)"
_ROLES = "'system|user' AS roles, '{s}|' || {p} AS contents".format(s=text.SYSTEM_MESSAGE, p=_PROMPT)

SQL = {
    "scan_mcq_csv": f"""WITH {_MCQ} SELECT id, paragraph, '{{''question'': "' || question || '", ''choices'': ["' || array_to_string(choices, '", "') || '"], ''answer'': ' || answer || ', ''question_plus'': ' || coalesce('"' || question_plus || '"', 'None') || '}}' AS problems FROM mcq""",
    "flatten_mcq": f"WITH {_MCQ} SELECT id, paragraph, question, array_to_string(choices, '|') AS choices, answer, question_plus, NULL::VARCHAR AS error FROM mcq",
    "parse_props": "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, NULL::VARCHAR AS error FROM events",
    "stage_counts": f"WITH {_MCQ}, s AS (SELECT {_ORDER.format(id='id')} AS i, ceil(count(*) OVER () * 0.1::DECIMAL(3,1)) AS k FROM mcq) SELECT stage, count(*) AS n FROM (SELECT unnest(['flattened', CASE WHEN i < k THEN 'test' ELSE 'train' END]) AS stage FROM s) GROUP BY stage",
    "submission": f"WITH {_MCQ}, {_ANSWERS} SELECT id, answer FROM answers",
    "metric_log_json": f"""WITH l AS (SELECT event_type || '/' || (user_id % 10)::VARCHAR AS name, value, event_id AS step, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp, step, value) - 1 AS i FROM l)
SELECT name, (i // {source.BLOCK})::BIGINT AS block, count(*)::INTEGER AS n, string_agg(coalesce(printf('%.6f', value), '~') || ' ' || step::VARCHAR || ' ' || timestamp, '|' ORDER BY i) AS entries FROM r GROUP BY ALL""",
    "metric_log_long": "SELECT event_type || '/' || (user_id % 10)::VARCHAR AS name, value, event_id AS step, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events",
    "log_levels": "SELECT CASE WHEN value > 100 THEN 'WARNING' WHEN value IS NULL THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY level",
    "best_checkpoint": f"""WITH {_LOG}, b AS (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value NULLS LAST, step) AS k FROM log),
i AS (SELECT run, count(*) FILTER (WHERE value < coalesce(m, 'inf'::DOUBLE)) AS n_improvements FROM (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM log) GROUP BY run)
SELECT run, step, value, n_improvements FROM b JOIN i USING (run) WHERE k = 1""",
    "running_best": f"WITH {_LOG} SELECT run, step, value, m AS best_before, value IS NOT NULL AND (m IS NULL OR value > m) AS is_best FROM (SELECT *, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM log)",
    "latest_checkpoint": f"WITH {_ARTIFACTS} SELECT name, step FROM (SELECT name, try_cast(split_part(name, '-', 2) AS BIGINT) AS step FROM artifacts) ORDER BY step DESC NULLS LAST LIMIT 1",
    "checkpoint_order": f"WITH {_ARTIFACTS} SELECT name, coalesce(try_cast(split_part(name, '-', 2) AS BIGINT), 0) AS step FROM artifacts ORDER BY step, name",
    "question_length": f"WITH {_MCQ} SELECT id, f AS full_question, length(f)::INTEGER AS question_length FROM (SELECT id, question || coalesce(' ' || question_plus, '') AS f FROM mcq)",
    "missing_values": f"WITH {_MCQ} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM mcq" for c in ("id", "paragraph", "question", "choices", "answer", "question_plus")),
    "length_histogram": """WITH d AS (SELECT length(text) AS n FROM documents), m AS (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM d),
c AS (SELECT least(floor((n - lo) * 30 / (hi - lo)), 29)::INTEGER AS bin, count(*) AS n FROM d, m GROUP BY bin)
SELECT b::INTEGER AS bin, round(lo + b * ((hi - lo) / 30), 6) AS low, round(lo + (b + 1) * ((hi - lo) / 30), 6) AS high, coalesce(c.n, 0) AS n FROM range(30) AS r(b) CROSS JOIN m LEFT JOIN c ON c.bin = b""",
    "tfidf_vocab": f"WITH {_TF}, {_VOCAB.format(n=TERMS)} SELECT term, ctf, df FROM vocab",
    "tfidf_weights": f"WITH {_WEIGHTS.replace('{n}', str(TERMS))} SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
    "tfidf_wide": f"""WITH {_WEIGHTS.replace('{n}', '20')} SELECT doc_id, string_agg(printf('%.6f', coalesce(round(weight, 6), 0)), '|' ORDER BY term) AS weights
FROM (SELECT doc_id FROM documents) CROSS JOIN (SELECT term FROM vocab) LEFT JOIN weights USING (doc_id, term) GROUP BY doc_id""",
    "tfidf_head": f"WITH {_WEIGHTS.replace('{n}', str(TERMS))} SELECT doc_id, term, round(weight, 6) AS weight FROM weights ORDER BY doc_id, term LIMIT 20",
    "numbered_choices": f"WITH {_MCQ} SELECT id, {_NUMBERED} AS choices FROM mcq",
    "create_prompt": f"WITH {_MCQ} SELECT id, {_PROMPT} AS prompt FROM mcq",
    "training_messages": f"WITH {_MCQ} SELECT id, roles || '|assistant' AS roles, contents || '|' || answer AS contents, answer AS label FROM (SELECT id, answer, {_ROLES} FROM mcq)",
    "inference_messages": f"WITH {_MCQ} SELECT id, {_ROLES}, len(choices)::INTEGER AS len_choices FROM mcq",
    "render_chat": f"WITH {_CHATS} SELECT conv_id, chat FROM chats",
    "build_vocab": f"WITH {_IDS} SELECT term, n, id FROM vocabulary",
    "tokenize_docs": f"""WITH {_IDS}, p AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM d),
e AS (SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY i) AS ids FROM p LEFT JOIN vocabulary USING (term) GROUP BY doc_id)
SELECT doc_id, coalesce(ids, '') AS input_ids, len(t)::INTEGER AS attended FROM d LEFT JOIN e USING (doc_id)""",
    "filter_by_length": f"SELECT doc_id, n FROM (SELECT doc_id, len({_TOKENS % 'text'})::INTEGER AS n FROM documents) WHERE n <= {LENGTH}",
    "completion_mask": f"WITH {_CHATS}, d AS (SELECT conv_id, {_TOKENS % 'chat'} AS t FROM chats) SELECT conv_id, array_to_string({_MASKED}, ' ') AS labels FROM d",
    "decode_labels": f"WITH {_MCQ} SELECT id, answer - 1 AS class FROM mcq",
    "train_test_split": f"SELECT doc_id, CASE WHEN i < k THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, {_ORDER.format(id='doc_id')} AS i, ceil(count(*) OVER () * 0.1::DECIMAL(3,1)) AS k FROM documents)",
    "pad_batches": f"""WITH d AS (SELECT doc_id, len({_TOKENS % 'text'})::INTEGER AS n, ({_ORDER.format(id='doc_id')}) // {BATCH} AS batch FROM documents)
SELECT doc_id, batch::BIGINT AS batch, max(n) OVER (PARTITION BY batch) AS padded, n AS attended FROM d""",
    "training_data": f"""WITH {_MCQ}, t AS (SELECT id, len({_TOKENS % ("'" + text.SYSTEM_MESSAGE + "' || " + _nl(text.TURN_START + "user" + chr(10)) + " || " + _PROMPT + " || " + _MODEL_TURN + " || answer || " + _nl(text.TURN_END + chr(10)))})::INTEGER AS n, {_ORDER.format(id='id')} AS i FROM mcq)
SELECT id, n, 2 AS n_labels, CASE WHEN i < ceil((SELECT count(*) FROM t) * 0.1::DECIMAL(3,1)) THEN 'test' ELSE 'train' END AS split FROM t""",
    "question_profile": f"""WITH {_MCQ}, documents AS (SELECT id AS doc_id, question || coalesce(' ' || question_plus, '') AS text, length(question || coalesce(' ' || question_plus, ''))::DOUBLE AS x FROM mcq),
{_WEIGHTS.replace('{n}', str(TERMS))}, m AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM documents),
c AS (SELECT least(floor((x - lo) * 30 / (hi - lo)), 29)::INTEGER AS bin, count(*) AS n FROM documents, m GROUP BY bin)
SELECT 'length' AS kind, b::VARCHAR AS key, coalesce(c.n, 0)::DOUBLE AS value FROM range(30) AS r(b) LEFT JOIN c ON c.bin = b
UNION ALL SELECT 'term', term, round(sum(weight), 4) FROM weights GROUP BY term
UNION ALL """ + " UNION ALL ".join(f"SELECT 'missing', '{c}', (count(*) - count({c}))::DOUBLE FROM mcq" for c in ("id", "paragraph", "question", "choices", "answer", "question_plus")),
    "log_entries": """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END AS timestamp,
CASE WHEN value > 100 THEN 'WARNING' ELSE 'INFO' END AS level, 'event ' || event_id AS message FROM events""",
    "run_names": """SELECT strftime(ts, 'exp_%Y%m%d_%H%M%S') AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END AS stamp, count(*) AS n
FROM (SELECT ts FROM events UNION ALL SELECT o_orderdate::TIMESTAMP FROM orders) GROUP BY ALL""",
    "render_inference": f"WITH {_MCQ} SELECT id, '{text.SYSTEM_MESSAGE}' || {_nl(text.TURN_START + 'user' + chr(10))} || {_PROMPT} || {_MODEL_TURN} AS chat FROM mcq",
    "scored_choices": f"WITH {_MCQ} SELECT id, (id::BIGINT % 5 + 1)::VARCHAR AS answer FROM mcq",
    "submit_latest": f"""WITH {_MCQ}, {_ARTIFACTS}, latest AS (SELECT name FROM artifacts ORDER BY try_cast(split_part(name, '-', 2) AS BIGINT) DESC NULLS LAST LIMIT 1)
SELECT id, (id::BIGINT % 5 + 1)::VARCHAR AS answer, name AS run FROM mcq, (SELECT name FROM latest UNION ALL SELECT 'best_model') AS r""",
    "stream_answers": f"WITH {_MCQ} SELECT id, (id::BIGINT % 5 + 1)::VARCHAR AS answer FROM mcq",
    "unanswered_questions": "SELECT vec_id AS id, (vec_id % 8)::INTEGER AS len_choices FROM embeddings WHERE vec_id % 8 NOT BETWEEN 1 AND 5",
    "staged_questions": f"WITH {_MCQ} SELECT id, answer, CASE WHEN i < k THEN 'test' ELSE 'train' END AS split FROM (SELECT id, answer, {_ORDER.format(id='id')} AS i, ceil(count(*) OVER () * 0.1::DECIMAL(3,1)) AS k FROM mcq)",
    "submission_runs": f"WITH {_MCQ} SELECT id, answer, run FROM mcq, (VALUES ('checkpoint-1000', '3'), ('best_model', '2'), ('checkpoint-2000', '4')) AS r(run, answer)".replace("SELECT id, answer, run", "SELECT id, r.answer, run"),
    "lexical_scores": f"""WITH {_MCQ}, q AS (SELECT id::BIGINT AS key, CASE id::BIGINT % 7 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] ELSE choices END AS c, {_TERMS_OF % "paragraph || ' ' || question"} AS context FROM mcq),
rows_ AS (SELECT key, i - 1 AS k, {_TERMS_OF % "c[i]"} AS terms, context FROM q, unnest(range(1, coalesce(len(c), 0) + 1)) AS u(i)),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM rows_) GROUP BY term),
hits AS (SELECT key, k, sum(ln((1.0 + (SELECT count(*) FROM rows_)) / (1.0 + df)) + 1.0) AS s FROM (SELECT key, k, unnest(list_intersect(terms, context)) AS term FROM rows_) JOIN df USING (term) GROUP BY ALL),
l AS (SELECT key, string_agg(printf('%.6f', round(coalesce(s, 0), 9)), '|' ORDER BY k) AS logits FROM rows_ LEFT JOIN hits USING (key, k) GROUP BY key)
SELECT (key // 2)::VARCHAR AS id, len(c)::INTEGER AS len_choices, coalesce(logits, '') AS logits FROM q LEFT JOIN l USING (key)""",
    "running_best_stamps": f"WITH {_LOG}, w AS (SELECT run, (step % 1000 - 500) * 1000000000000000 + step AS step, value FROM log) SELECT run, step, value, m AS best_before, value IS NOT NULL AND (m IS NULL OR value < m) AS is_best FROM (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w)",
    "best_records": """WITH l AS (SELECT event_type || '/' || (user_id % 10)::VARCHAR AS run, value, event_id AS step FROM events WHERE value IS NOT NULL)
SELECT run, 'checkpoint-' || step AS original_checkpoint, step, value AS metric, 'eval_loss' AS metric_name FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, step) AS k FROM l) WHERE k = 1""",
    "tokenize_reused": f"""WITH {_IDS}, p AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM d),
e AS (SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY i) AS ids FROM p LEFT JOIN vocabulary USING (term) GROUP BY doc_id)
SELECT doc_id, coalesce(ids, '') AS input_ids, len(t)::INTEGER AS attended FROM d LEFT JOIN e USING (doc_id)""",
    "logits_evaluation": f"""WITH l AS (SELECT [embedding[48 + i + 1]::DOUBLE for i in [3, 1, 4, 5, 2]] AS five, label FROM embeddings),
g AS (SELECT CASE WHEN label < 9 THEN label % 5 ELSE 0 END AS y, list_position(five, list_max(five)) - 1 AS p FROM l), {_F1}
SELECT round(avg((y = p)::INTEGER), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM f1) AS macro_f1, count(*) AS n, (SELECT count(*) FROM f1) AS n_classes FROM g""",
    "evaluate_metrics": f"""WITH {_GRADED}, {_F1}, k AS (SELECT sum(a * b) AS chance FROM (SELECT c, avg((y = c)::INTEGER) AS a, avg((p = c)::INTEGER) AS b FROM g, f1 WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY c)),
a AS (SELECT avg((y = p)::INTEGER) AS accuracy FROM g)
SELECT round(accuracy, 6) AS accuracy, (SELECT round(avg(f1), 6) FROM f1) AS macro_f1, round((accuracy - chance) / (1 - chance), 6) AS kappa FROM a, k""",
    "rejected_answers": "SELECT vec_id AS id, CASE WHEN vec_id % 8 < 1 THEN 'no choices' ELSE 'more than 5 choices' END AS reason FROM embeddings WHERE vec_id % 8 NOT BETWEEN 1 AND 5",
    "eval_logits": "SELECT vec_id, array_to_string([printf('%.6f', embedding[48 + i + 1]::DOUBLE) for i in [3, 1, 4, 5, 2]], '|') AS logits FROM embeddings",
    "gather_logits": f"WITH {_LOGITS} SELECT vec_id, array_to_string([printf('%.6f', x) for x in logits], '|') AS logits FROM l",
    "choice_softmax": f"WITH {_LOGITS}, x AS (SELECT vec_id, unnest(range(5))::INTEGER AS k, unnest(logits) AS v FROM l) SELECT vec_id, k, round(exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id), 6) AS p FROM x",
    "choice_argmax": f"WITH {_LOGITS} SELECT vec_id AS id, list_position(logits[1:n], list_max(logits[1:n]))::VARCHAR AS answer FROM l",
    "predict_choice": f"WITH {_MCQ}, {_ANSWERS} SELECT id, answer FROM answers",
    "evaluate_answers": f"""WITH {_MCQ}, {_ANSWERS}, g AS (SELECT mcq.answer::VARCHAR AS y, answers.answer AS p FROM mcq JOIN answers USING (id)), {_F1}
SELECT round(avg((y = p)::INTEGER), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM f1) AS macro_f1, count(*) AS n, (SELECT count(*) FROM f1) AS n_classes FROM g""",
    "accuracy": f"WITH {_GRADED} SELECT round(avg((y = p)::INTEGER), 6) AS accuracy, count(*) AS n FROM g",
    "macro_f1": f"WITH {_GRADED}, {_F1} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n_classes FROM f1",
    "confusion_matrix": f"WITH {_GRADED} SELECT y, p, count(*) AS n FROM g GROUP BY ALL",
}
