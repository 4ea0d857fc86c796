import ast
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quizloom.functions import arrays, literal, text
from quizloom.operators import metrics, profile, runs, score, split, tokens
from quizloom.plans import jobs
from quizloom.sources import mcq, reuse
from quizloom.streaming.answers import answer_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_literals(spark):
    cells = ["{'question': 'q', 'choices': ('a', 'b',), 'answer': None}", "{'question': '\\xa0', 'choices': ['it\\'s'], 'answer': 2,}", "{'question': 'q'}", "{oops", "f()", None]
    raw = spark.createDataFrame([(str(i), "p", c) for i, c in enumerate(cells)], mcq.RAW)
    rows = {r["id"]: r for r in mcq.flatten(raw).collect()}
    assert rows["0"]["choices"] == ["a", "b"] and rows["0"]["answer"] is None and rows["0"]["error"] is None
    assert rows["1"]["question"] == "\xa0" and rows["1"]["choices"] == ["it's"] and rows["1"]["answer"] == 2
    assert [rows[str(i)]["error"] for i in (2, 3, 4, 5)] == ["KeyError", "SyntaxError", "ValueError", "ValueError"]
    cells = ["{'question': 'q', 'choices': ['a'], 'answer': '2'}", "{'question': 'q', 'choices': 'a'}", "[1]", "{'question': None, 'choices': ['a'], 'answer': 1}"]
    rows = mcq.flatten(spark.createDataFrame([(str(i), "p", c) for i, c in enumerate(cells)], mcq.RAW)).orderBy("id").collect()
    assert [r["error"] for r in rows] == ["TypeError", "TypeError", "TypeError", None] and rows[3]["answer"] == 1
    assert one(spark, literal.parse_json(F.lit('{"question": "q", "choices": ["a"]}'), literal.PROBLEM)["choices"]) == ["a"]


def test_both_tiers_of_literals_agree(spark):
    cells = ["{}", "{'a': 1}", '{"a": [1, -2.5, "x y"], \'b\': "it\'s"}', "{'a': true}", "{'a': 01}", "{'a': 1} ", "{'a': 1}{'b': 2}", "{'a': 'x' 'y'}", "{'a': '한국 \"q\"'}", "{'a': 1,}", "{1: 2}", "{'a' 1}", "{'a': 1_000}", "{'a': 'b\\n'}", "{'a': [1}", "{'a': 1e5}", "{'a', 'b'}", "{'a': {'b': 1}}", "{'a': 1 2}", "{'a': '\t'}", "{'a': 1, 'a': 2}"]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    got = df.select("t", literal.literal_json("t").alias("l"), F.col("t").rlike(literal.FLAT).alias("flat")).collect()
    for row in got:
        try:
            want, error = json.loads(json.dumps(ast.literal_eval(row["t"]), default=literal.plain)), None
        except (SyntaxError, ValueError) as e:
            want, error = None, type(e).__name__
        assert row["l"]["error"] == error and (row["l"]["json"] is None if error else json.loads(row["l"]["json"]) == want), row["t"]
    assert sum(r["flat"] for r in got) >= 5


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", ok', "a\nb"), ("2", "back\\slash", "NA"), ("3", None, "{'x': 1}")]
    path = str(tmp_path / "raw")
    mcq.write_csv(spark.createDataFrame(rows, mcq.RAW), path, single_file=True)
    assert sorted(map(tuple, mcq.read_mcq(spark, path).collect())) == rows
    assert mcq.read_mcq(spark, path, ("NA",)).where("problems is null").count() == 1
    with pytest.raises(AnalysisException):
        mcq.read_mcq(spark, str(tmp_path / "none"))


def test_submission_replaces(spark, tmp_path):
    path = str(tmp_path / "deep" / "output.csv")
    for n in (3, 2):
        out = mcq.write_submission(spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("1").alias("answer")), path, True)
    assert out.count() == 2 and out.columns == ["id", "answer"]


def test_prompt_keeps_text_verbatim(spark):
    got = one(spark, text.prompt(F.lit("{p} %s $1"), F.lit(None), F.array(F.lit("가"), F.lit(None), F.lit("c")), F.lit(" ")))
    assert got == "지문:\n{p} %s $1\n\n질문:\n\n\n<보기>:\n \n\n선택지:\n1 - 가\n2 - \n3 - c\n\n1, 2, 3, 4, 5 중에 하나를 정답으로 고르세요.\n정답:"
    assert "<보기>" not in one(spark, text.prompt(F.lit("p"), F.lit("q"), F.array(F.lit("a")), F.lit("")))


def test_chat_template(spark):
    turns = [("system", "S"), ("user", "u"), ("system", "late"), ("tool", "t"), ("assistant", None)]
    messages = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).cast("string").alias("content")) for r, c in turns))
    assert one(spark, text.turn_template(messages, add_generation_prompt=True)) == "S<start_of_turn>user\nu<end_of_turn>\n<start_of_turn>model\n<end_of_turn>\n"
    assert one(spark, text.turn_template(F.lit([]).cast(text.MESSAGES))) == ""
    own = lambda m: m
    assert text.choose_template(own) is own and text.choose_template(None, "Gemma-2", own) is text.turn_template
    assert text.choose_template(None, "x", own) is own and text.choose_template() is text.turn_template


@pytest.mark.parametrize(
    ("ids", "labels"),
    [([1, 7, 5, 6], [-100, -100, 5, 6]), ([1, 7, 1, 7, 9], [-100] * 4 + [9]), ([5, 6, 7], [-100] * 3), ([1], [-100]), ([], []), ([3, 1, 7], [-100] * 3)],
)
def test_completion_mask(spark, ids, labels):
    assert one(spark, arrays.completion_mask(F.lit(ids).cast("array<int>"), F.array(F.lit(1), F.lit(7)), 2, F.lit(-100))) == labels


def test_choices(spark):
    rows = [("a", 4, [0.0, 2.0, 2.0, 1.0, 9.0]), ("b", 5, [0.0, 2.0, 2.0, 1.0, 9.0]), ("c", 0, [1.0]), ("d", 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    got = {r["id"]: r["answer"] for r in score.predictions(spark.createDataFrame(rows, "id string, len_choices int, logits array<double>")).collect()}
    assert got == {"a": "2", "b": "5", "c": None, "d": None}
    assert abs(sum(one(spark, arrays.softmax(F.array(F.lit(1000.0), F.lit(999.0), F.lit(-5.0))))) - 1) < 1e-9
    assert one(spark, arrays.gather(F.array(F.lit(0.5), F.lit(0.7)), F.array(F.lit(1), F.lit(9)))) == [0.7, None]


def test_decoding(spark):
    labels = F.array(F.lit("-100"), F.lit("\n　"), F.lit("3"), F.lit("<end_of_turn>"), F.lit("\n"))
    assert one(spark, metrics.decoded_class(labels, F.lit("-100"))) == 2
    assert one(spark, arrays.class_of(F.lit("x"))) == 0 and one(spark, arrays.class_of(F.lit("x"), None)) is None


def test_split_and_batches(spark):
    df = spark.range(101).select("id", F.array_repeat(F.lit(7), (F.col("id") % 5).cast("int")).alias("input_ids"), F.array_repeat(F.lit(1), (F.col("id") % 5).cast("int")).alias("labels"))
    train, test = split.train_test_split(df, "id")
    assert (train.count(), test.count()) == (90, 11) and train.union(test).select("id").distinct().count() == 101
    assert test.select("id").exceptAll(split.train_test_split(df.repartition(7), "id")[1].select("id")).isEmpty()
    padded = split.pad_batches(df, "id", 8, 2, labels_col="labels").groupBy("batch").agg(F.count_distinct(F.size("input_ids")).alias("sizes"), F.count_distinct(F.size("labels")).alias("l"), F.count("*").alias("n"))
    assert all(r["sizes"] == r["l"] == 1 and r["n"] <= 8 for r in padded.collect())


def plain_running_best(rows, greater):
    best, out = {}, {}
    for run, _, value, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        old = best.get(run)
        better = value is not None and (old is None or (value > old if greater else value < old))
        out[i] = (old, better)
        best[run] = value if better else old
    return out


@pytest.mark.parametrize("greater", [True, False])
def test_running_best_whatever_the_steps(spark, greater):
    values = [None if i % 11 == 5 else float((i * 53) % 29) for i in range(300)]
    steps = {
        "spread": [(i * 37) % 101 if i % 10 else None for i in range(300)],
        "outlier": [10**13 if i == 17 else i % 250 for i in range(300)],
        "wide": [(-1) ** i * (i * 37 % 301) * 10**16 for i in range(300)],
        "null": [None] * 300,
        "same": [7] * 300,
    }
    rows = [(None if name == "spread" and i % 3 else name, step, values[i], 1000 * k + i) for k, (name, of) in enumerate(steps.items()) for i, step in enumerate(of)]
    log = spark.createDataFrame(rows, "run string, step long, value double, __other int").coalesce(1)
    got = {r["__other"]: (r["best_before"], r["is_best"]) for r in runs.running_best(log, greater).collect()}
    assert got == plain_running_best(rows, greater)
    best = {r["run"]: (r["step"], r["value"]) for r in runs.improvements(log, greater).collect()}
    assert best == {r["run"]: (r["step"], r["value"]) for r in runs.final_best(log, greater).collect() if r["run"] in best} or greater


def test_a_run_of_one_step_spreads(spark):
    for steps in (F.lit(5), F.lit(None).cast("long"), F.when(F.col("id") == 9, 10**13).otherwise(F.col("id") % 3)):
        log = spark.range(100_000).select(F.lit("r").alias("run"), steps.cast("long").alias("step"), F.rand(1).alias("value"))
        conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            parts = [r["count"] for r in mcq.in_order(log, "log", "run", "step").groupBy("__part").count().collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
        assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < 2 * 100_000 / len(parts)


def test_runs_without_values(spark):
    log = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5), ("b", 3, 0.25), ("b", 4, 0.25), (None, 1, 2.0)], "run string, step long, value double")
    assert {r["run"]: tuple(r)[1:] for r in runs.improvements(log).collect()} == {"a": (None, None, 0), "b": (3, 0.25, 2), None: (1, 2.0, 1)}


def test_records_from_a_log(spark, tmp_path):
    rows = [("a", 0.5, 10, "t1"), ("a", 0.4, 20, "t2"), ("a", 0.4, 30, "t3"), ("a", None, 40, "t4"), ("b", 0.1, None, "t1"), ("b", 3.0, 5, "t2"), ("c", None, 1, "t1")]
    series = mcq.metric_series(spark.createDataFrame(rows, "name string, value double, step long, timestamp string"))
    out = {r["run"]: (r["original_checkpoint"], r["step"], r["metric"], r["metric_name"]) for r in jobs.best_records(series, str(tmp_path / "best"), "eval_loss").collect()}
    assert out == {"a": ("checkpoint-20", 20, 0.4, "eval_loss"), "b": ("checkpoint-5", 5, 3.0, "eval_loss")}
    assert jobs.best_records(series, str(tmp_path / "best"), "accuracy", True).where("run = 'a'").first()["step"] == 10


def test_stages_are_counted_as_rows_pass(spark):
    cells = ["{'question': 'q', 'choices': ['a'], 'answer': 1}"] * 21 + ["{oops", None]
    rows, counts = jobs.staged(spark.createDataFrame([(str(i), "p", c) for i, c in enumerate(cells)], mcq.RAW))
    assert {r["stage"]: r["n"] for r in counts.collect()} == {"raw": 23, "flattened": 21, "test": 3, "train": 18}
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"test": 3, "train": 18}


def test_tables_are_reused(spark, tmp_path):
    path, calls = str(tmp_path / "texts"), spark.sparkContext.accumulator(0)
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string").write.parquet(path)

    class Counting(tokens.FileTokenizer):
        def __init__(self, name):
            self.name = name

        def encode(self, column):
            @F.udf("array<int>")
            def ids(t):
                calls.add(1)
                return [len(t)]

            return ids(column)

        def digest(self):
            return self.name

    build = lambda name, rows=None, **more: jobs.tokenized(spark.read.parquet(path) if rows is None else rows, "text", Counting(name), ("id",), **more)
    first = sorted(map(str, build("a").collect()))
    assert len(first) == 20 and calls.value == 20
    assert sorted(map(str, build("a").collect())) == first and calls.value == 20  # found
    build("b").collect()
    assert calls.value == 40  # another tokenizer
    build("a", spark.read.parquet(path).where("id < 5")).collect()
    assert calls.value == 45  # other rows of the same files
    build("a", reuse=False).collect()
    assert calls.value == 65
    spark.createDataFrame([(99, "new")], "id long, text string").write.mode("append").parquet(path)
    assert build("a").count() == 21 and calls.value == 86  # other files
    build("a", spark.createDataFrame([(1, "x")], "id long, text string")).collect()
    build("a", spark.createDataFrame([(1, "x")], "id long, text string")).collect()
    assert calls.value == 88  # rows that are in no file have no identity


def test_identity_of_a_frame(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.option("header", True).csv(path)
    read = lambda **how: spark.read.schema("id string").csv(path, **how)
    wide = lambda last: spark.read.schema("id long").csv(path).select(*((F.col("id") + i).alias(f"c{i}") for i in range(60)), F.lit(last).alias("last"))
    frames = [read(), read(header=True), read().where("id > 1"), read().where("id > 2"), wide(1), wide(2)]
    found = [reuse.identity(df) for df in frames]
    assert None not in found and len(set(found)) == len(frames) and reuse.identity(read()) == found[0]
    assert [reuse.identity(df) for df in (spark.range(3), read().withColumn("x", F.rand()), read().select(F.udf(len)("id")))] == [None] * 3


def test_training_data_with_a_tokenizer_file(spark, sf_dir):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from quizloom.plans import registry

    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    questions = registry.mcq(spark, sf_dir)
    rows = {r["id"]: r for r in jobs.training_data(questions, tokenizer=tokens.FileTokenizer(path)).collect()}
    chats = jobs.training_examples(questions).select("id", text.turn_template(F.col("messages")).alias("chat")).collect()
    opening = own.encode(text.RESPONSE, add_special_tokens=False).ids
    assert rows and len(opening) > 2
    for r in chats:
        ids = own.encode(r["chat"], add_special_tokens=False).ids
        at = max(i for i in range(len(ids)) if ids[i : i + len(opening)] == opening) + len(opening)
        assert rows[r["id"]]["input_ids"] == ids and rows[r["id"]]["labels"] == [-100] * at + ids[at:]
    with pytest.raises(ValueError):
        jobs.training_data(questions, tokenizer=tokens.FileTokenizer(path), response="")


def test_evaluation_from_logits(spark):
    pieces = ["<unk>", "1", "2", "3", "4", "<end_of_turn>", "\n"]  # no "5"
    line = lambda *best: [[3.0 if i == b else 0.0 for i in range(7)] for b in best]
    rows = [(line(2, 2, 5), [-100, 2, 5]), (line(3, 4, 5), [-100, -100, 3, 5, 6]), (line(0, 0, 0), [-100]), (line(1), [1]), (None, [4, 5]), (line(0, 0, 0), [99, 6, 4, 5])]
    df = spark.createDataFrame(rows, "sequence array<array<double>>, labels array<int>")
    # Predictions: 1, 3, 4 (the missing piece has id 0's logit), none (too short), none, 4; truth: 1, 2, 0, 0, 3, 3.
    got = jobs.evaluate_logits(df, pieces, given={"accuracy": metrics.accuracy_of, "n": metrics.count_of, "hits": lambda c: metrics.cells_where(c, lambda x: x["y"] == x["p"])}).first()
    assert (got["accuracy"], got["n"], got["hits"]) == (0.25, 6, 1)


def test_given_metrics_share_a_table(spark):
    from quizloom.plans import registry

    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2), (2, 2), (2, 1), (3, None)], "y int, p int")
    got = metrics.evaluation(pairs, {"kappa": registry.kappa, "n": metrics.count_of}).first()
    assert got["kappa"] == pytest.approx(1 / 3) and got["n"] == 7
    assert metrics.evaluation(pairs.limit(0), {"kappa": registry.kappa}).first()["kappa"] is None


def test_logs(spark, tmp_path):
    ts = F.lit("2024-03-05 06:07:08").cast("timestamp")
    assert one(spark, runs.run_name(ts)) == "exp_20240305_060708" and one(spark, runs.iso_stamp(ts)) == "2024-03-05T06:07:08"
    assert one(spark, runs.iso_stamp(F.lit("2024-03-05 06:07:08.25").cast("timestamp"))) == "2024-03-05T06:07:08.250000"
    path = str(tmp_path / "log")
    for message, level in (("시작", None), ("late", "WARNING")):
        mcq.append_log(spark.range(1).select(runs.log_entry(F.lit(message), F.lit(level).cast("string"), ts).alias("e")).select("e.*"), path)
    log = spark.read.json(path)
    assert {tuple(r) for r in log.select("level", "message", "timestamp").collect()} == {("INFO", "시작", "2024-03-05T06:07:08"), ("WARNING", "late", "2024-03-05T06:07:08")}
    assert {r["level"]: r["n"] for r in runs.levels(log).collect()} == {"INFO": 1, "WARNING": 1}
    mcq.write_config(spark, {"이름": "x", "rate": 2e-5}, str(tmp_path / "config"))
    assert json.loads(spark.read.text(str(tmp_path / "config")).first()[0]) == {"이름": "x", "rate": 2e-5}
    best = runs.final_best(spark.createDataFrame([("r", 10, 0.5), ("r", 20, 0.4)], "run string, step long, value double"))
    mcq.write_best(best, str(tmp_path / "best"), "eval_loss")
    assert spark.read.json(str(tmp_path / "best")).first().asDict() == {"run": "r", "original_checkpoint": "checkpoint-20", "step": 20, "metric": 0.4, "metric_name": "eval_loss"}


def test_submissions_of_many_runs(spark, tmp_path):
    assert mcq.submission_path("/data/", "out/checkpoint-1000/") == "/data/submissions/checkpoint-1000/output.csv"
    rows = spark.createDataFrame([("1", "2", "checkpoint-1000"), ("2", "5", "best_model")], "id string, answer string, run string")
    assert sorted(map(tuple, mcq.write_submissions(rows, str(tmp_path)).select("id", "answer", "run").collect())) == sorted(map(tuple, rows.collect()))
    assert (tmp_path / "submissions" / "run=best_model").is_dir()


def test_submissions_keep_other_runs(spark, tmp_path):
    of = lambda *rows: spark.createDataFrame(rows, "id string, answer string, run string")
    mcq.write_submissions(of(("1", "1", "checkpoint-1"), ("2", "2", "checkpoint-1"), ("1", "5", "best_model")), str(tmp_path))
    mcq.write_submissions(of(("1", "3", "checkpoint-2")), str(tmp_path))
    mcq.write_submissions(of(("2", "4", "checkpoint-1")), str(tmp_path))
    want = {("2", "4", "checkpoint-1"), ("1", "5", "best_model"), ("1", "3", "checkpoint-2")}
    assert {tuple(r) for r in mcq.read_submissions(spark, str(tmp_path)).collect()} == want


def test_submit_a_checkpoint(spark, tmp_path):
    questions = spark.createDataFrame([("1", "p", "q", ["a", "b"], 1, None), ("2", "p", "q", ["a", "b", "c"], 1, None)], "id string, paragraph string, question string, choices array<string>, answer int, question_plus string")
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("best_model",)], "name string")
    last = lambda _: lambda: lambda batch: batch["len_choices"].map(lambda n: [0.0] * (n - 1) + [1.0])
    run, rows = jobs.submit(questions, str(tmp_path), last, names)
    assert run == "checkpoint-10" and {(r["id"], r["answer"]) for r in rows.collect()} == {("1", "2"), ("2", "3")}
    run, rows = jobs.submit(questions.where("id = '1'"), str(tmp_path), lambda _: None, checkpoint="out/checkpoint-9/")
    assert run == "checkpoint-9" and rows.count() == 1 and mcq.read_submissions(spark, str(tmp_path)).count() == 3
    assert jobs.submit(questions.where("id = '1'"), str(tmp_path), last, names)[1].count() == 1
    for nothing, error in ((None, ValueError), (names.where("name = 'best_model'"), FileNotFoundError)):
        with pytest.raises(error):
            jobs.submit(questions, str(tmp_path), last, nothing)
    assert jobs.evaluation(questions, rows, {"n": metrics.count_of}).first()["n"] == 1


def test_every_question_is_scored(spark):
    kind = "id string, paragraph string, question string, choices array<string>"
    rows = [("1", "red fox", "which animal", ["red fox", "blue whale"]), ("2", "p", "q", []), ("3", "p", "q", None), ("4", "blue whale", "q", ["red fox", "blue whale"]), ("4", "red", "q", ["red fox", "blue whale"]), ("5", "p", "q", [None, "x"]), (None, None, None, ["red"])]
    scores = score.lexical_scores(spark.createDataFrame(rows, kind))
    got = sorted((r["id"] or "", r["len_choices"], len(r["logits"])) for r in scores.collect())
    assert got == [("", 1, 1), ("1", 2, 2), ("2", 0, 0), ("3", None, 0), ("4", 2, 2), ("4", 2, 2), ("5", 2, 2)]
    assert sorted(r["answer"] for r in score.predictions(scores).where("id = '4'").collect()) == ["1", "2"]
    assert {r["id"]: r["reason"] for r in score.rejected(scores).collect()} == {"2": "no choices", "3": "no choices"}
    assert score.lexical_scores(spark.createDataFrame([], kind)).count() == 0


def test_rejected_and_evaluated_logits(spark):
    rows = [("a", 4, [0.0, 2.0]), ("c", 0, [1.0]), ("d", 6, [1.0] * 6), ("e", None, [1.0]), ("f", 2, None)]
    scores = spark.createDataFrame(rows, "id string, len_choices int, logits array<double>")
    assert {r["id"]: r["reason"] for r in score.rejected(scores).collect()} == {"c": "no choices", "d": "more than 5 choices", "e": "no choices", "f": "no scores"}
    assert {r["id"] for r in score.predictions(scores).where("answer is null").collect()} == {"c", "d", "e", "f"}
    sequence = F.array(*(F.array(*(F.lit(float(10 * i + j)) for j in range(3))) for i in range(4)))
    ids = F.array(F.lit(2), F.lit(None).cast("int"), F.lit(9))
    assert one(spark, arrays.answer_logits(sequence, ids)) == [22.0, 20.0, None] and one(spark, arrays.answer_logits(sequence, ids, -1))[0] == 32.0
    assert one(spark, arrays.answer_logits(sequence, ids, -9)) == [None] * 3


def test_evaluation_from_one_table(spark):
    pairs = spark.createDataFrame([("1", "1"), ("1", "2"), ("2", "2"), ("3", None), (None, "4"), ("2", "2")], "y string, p string")
    both = metrics.evaluation(pairs).first()
    assert both["accuracy"] == metrics.accuracy(pairs).first()["accuracy"] == 0.75 and both["n"] == 6
    assert (both["macro_f1"], both["n_classes"]) == (pytest.approx(metrics.macro_f1(pairs).first()["macro_f1"]), 4)
    assert metrics.evaluation(pairs.limit(0)).first()["n"] == 0


def test_map_batches(spark):
    made = lambda: lambda batch: batch.assign(n=batch["t"].str.len())
    got = tokens.map_batches(spark.createDataFrame([("ab",), ("c",)], "t string"), made, "t string, n long")
    assert {tuple(r) for r in got.collect()} == {("ab", 2), ("c", 1)}


def test_running_best(spark):
    log = spark.createDataFrame([("r", 1, None), ("r", 2, 0.5), ("r", 3, 0.5), ("r", 4, 0.7), ("r", 5, 0.4), ("n", 1, None)], "run string, step int, value double")
    assert [r["step"] for r in runs.running_best(log).where("is_best").orderBy("step").collect()] == [2, 5]
    best = {r["run"]: (r["step"], r["value"]) for r in runs.final_best(log).collect()}
    assert best == {"r": (5, 0.4), "n": (None, None)} and runs.final_best(log, True).where("run = 'r'").first()["step"] == 4
    names = spark.createDataFrame([("checkpoint-999",), ("checkpoint-2994",), ("best_model",)], "name string")
    assert runs.require_latest(names) == "checkpoint-2994" and runs.ordered_artifacts(names).first()["name"] == "best_model"
    with pytest.raises(FileNotFoundError):
        runs.require_latest(names.where("name = 'best_model'"))


def test_metric_series_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(mcq, "BLOCK", 100)
    log = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "busy").otherwise("other").alias("name"), (F.col("id") * 0.5).alias("value"), F.col("id").alias("step"), F.format_string("%05d", F.col("id") % 700).alias("timestamp"))
    series = mcq.metric_series(log)
    rows = series.select("name", "block", F.explode(F.from_json("json", mcq.LOG)).alias("n", "e")).select("name", "block", F.size("e").alias("size"), "e.timestamp", "e.step").orderBy("block").collect()
    assert len(rows) >= 30 and max(r["size"] for r in rows) <= 100
    for name in ("busy", "other"):
        order = [at for r in rows if r["name"] == name for at in zip(r["timestamp"], r["step"])]
        assert order == sorted(order)
    back = mcq.metric_rows(series)
    assert back.exceptAll(log).isEmpty() and log.exceptAll(back).isEmpty()


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "x")], "a int, b double, c string")
    assert {r["column"]: r["n_missing"] for r in profile.missing_values(df).collect()} == {"a": 0, "b": 1, "c": 1}
    flat = profile.histogram(spark.range(3).select(F.lit(4).alias("n")), "n", 10).collect()
    assert sum(r["n"] for r in flat) == 3 and (min(r["low"] for r in flat), max(r["high"] for r in flat)) == (3.5, 4.5)
    assert profile.histogram(spark.range(0).select(F.lit(4).alias("n")), "n").count() == 0
    texts = spark.createDataFrame([(1, "ab cd"), (2, "zz"), (3, None)], "id int, t string")
    wide = profile.tfidf_wide(profile.tfidf(texts, "id", "t", 2), ["ab", "cd"], texts).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [(1, pytest.approx(0.5**0.5), pytest.approx(0.5**0.5)), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    lost = spark.createDataFrame([(None, "ab"), (4, "zz")], "id int, t string")
    assert {r["id"]: r["ab"] for r in profile.tfidf_wide(profile.tfidf(lost, "id", "t"), ["ab"], lost).collect()} == {None: 1.0, 4: 0.0}
    words = profile.term_counts(spark.createDataFrame([(1, "한국 가 한국 ab")], "id int, t string"), "id", "t")
    assert {(r["term"], r["tf"]) for r in words.collect()} == {("한국", 2), ("ab", 1)}
    with pytest.raises(ValueError):
        profile.tfidf_wide(words, ["t"] * 3, words, limit=2)


def test_tfidf_moves_only_the_vocabulary(spark):
    rows = [(i, f"ab cd ab rare{i}") for i in range(50)] + [(7, "cd cd"), (None, "ab"), (None, "cd"), (60, None), (61, "lone")]
    texts = spark.createDataFrame(rows, "id int, t string")
    top, counts = profile.frequent_counts(texts, "id", "t", 2)
    assert [(r["term"], r["ctf"]) for r in top.orderBy("term").collect()] == [("ab", 101), ("cd", 53)]
    every = profile.term_counts(texts, "id", "t").where("term in ('ab', 'cd')")
    assert counts.count() == 102 and counts.exceptAll(every).isEmpty() and every.exceptAll(counts).isEmpty()
    assert [tuple(r) for r in profile.tfidf_vocabulary(texts, "id", "t", 2).collect()] == [("ab", 101, 51), ("cd", 53, 51)]
    weights = profile.tfidf(texts, "id", "t", 2)
    # What is returned reads counts of the vocabulary's terms, not texts: no other term passes an exchange with its id.
    assert "Generate" not in weights._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["id"], r["term"]): r["weight"] for r in weights.where("id = 7").collect()} == {(7, "ab"): pytest.approx(2 / 13**0.5), (7, "cd"): pytest.approx(3 / 13**0.5)}
    assert weights.where("id is null").count() == 2 and weights.where("id in (60, 61)").isEmpty()


def test_encoding_keeps_empty_texts(spark):
    df = spark.createDataFrame([(1, "가 b! b"), (2, ""), (3, None)], "id int, t string")
    vocabulary = tokens.build_vocabulary(df, "t", 2)
    rows = {r["id"]: r for r in tokens.tokenize(df, "t", tokens.encoder(vocabulary), ("id",)).collect()}
    assert rows[1]["input_ids"] == [0, 3, 4, 3] and rows[2]["input_ids"] == [] == rows[3]["input_ids"] and rows[1]["attention_mask"] == [1] * 4


def test_encoders_get_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("ab cd "), 2000).alias("t"))  # 36 MB in one part
    rows = tokens.map_batches(texts, lambda: lambda batch: batch[["id"]].assign(n=len(batch)), "id long, n int").agg(F.max("n"), F.count("*")).first()
    assert rows[0] * 12_000 < 3 * tokens.BATCH_BYTES and rows[1] == 3000
    vocabulary = spark.createDataFrame([("ab", 1, 0), ("cd", 1, 1)], "term string, n long, id int")
    for encode in (lambda: tokens.encoder(vocabulary)(tokens.tokens(F.col("t"))), lambda: tokens.FileTokenizer("unread").encode(F.col("t"))):
        spark.conf.unset(setting)
        encoded = texts.select("id", encode().alias("ids"))
        assert spark.conf.get(setting) == str(tokens.BATCH_BYTES)
    encoded = texts.select("id", tokens.encoder(vocabulary)(tokens.tokens(F.col("t"))).alias("ids"))
    assert encoded.where("size(ids) = 4000 and ids[0] = 0 and ids[3999] = 1").count() == 3000


def test_jobs_and_stream(spark, sf_dir, tmp_path):
    from quizloom.plans import registry

    questions = registry.mcq(spark, sf_dir)
    data = jobs.training_data(questions).collect()
    assert len(data) == questions.count() and all(len(r["labels"]) == len(r["input_ids"]) for r in data)
    missing, lengths, weights = jobs.profiling(questions)
    assert missing.count() == 6 and lengths.agg(F.sum("n")).first()[0] == len(data) and not weights.isEmpty()
    scorer = lambda: lambda batch: batch["len_choices"].map(lambda n: [0.0] * (n - 1) + [1.0])
    batch = {tuple(r) for r in jobs.answers(questions, scorer).collect()}
    path = str(tmp_path / "questions")
    questions.write.parquet(path)
    answer_stream(spark.readStream.schema(questions.schema).parquet(path), scorer, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch and len(batch) == len(data)
    assert score.unanswered(questions, jobs.answers(questions)).isEmpty()
