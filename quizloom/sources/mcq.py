"""Question tables and submissions as CSV; logs as JSON."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizloom.functions.literal import PROBLEM, field_error, literal_json

RAW = "id string, paragraph string, problems string"
LOG = "map<string,array<struct<value:double,step:bigint,timestamp:string>>>"
#: Values that a block of a metric's series has at most.
BLOCK = 1 << 12
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, or, where none is set, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _own.setdefault(app, _own.get(app) or f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}")
    return f"{at.rstrip('/')}/quizloom"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, where several results are made from it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df as a table sorted as a whole by keys, then as it stood, with __part and __at, each row's part and place.

    Spark takes the parts' bounds from the data, and rows of equal keys may lie in several, so parts are
    even whatever the keys are. Null keys come first. The table is written: parts don't change once they are.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    rows = df.withColumn("__stood", F.monotonically_increasing_id()).orderBy(*keys, "__stood").drop("__stood")
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def read_mcq(spark: SparkSession, path: str, na_values: tuple[str, ...] = ()) -> DataFrame:
    """Raw questions. Cells may hold quotes ("" inside quotes) and newlines; a missing path fails here."""
    raw = spark.read.schema(RAW).csv(path, header=True, multiLine=True, quote='"', escape='"')
    for c in raw.columns if na_values else ():
        raw = raw.withColumn(c, F.when(~F.col(c).isin(*na_values), F.col(c)))
    return raw


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_submission(predictions: DataFrame, path: str, single_file: bool = False) -> DataFrame:
    """Columns id, answer with a header, replacing what is there; returns what was written."""
    out = predictions.select("id", "answer")
    write_csv(out, path, single_file)
    return predictions.sparkSession.read.schema("id string, answer string").csv(path, header=True, quote='"', escape='"')


def flatten(raw: DataFrame) -> DataFrame:
    """One row per raw row: id, paragraph, the problem's fields, and error (null if it could be read).

    error names what reading the cell raises: ValueError for a null cell, KeyError for a missing field,
    TypeError for a value of another type, or what the literal itself raises.
    """
    parsed = raw.withColumn("literal", literal_json("problems")).withColumn("p", F.from_json("literal.json", PROBLEM))
    wrong = field_error(F.col("literal.json"), F.col("p"), ["question", "choices"], ["question", "choices", "answer", "question_plus"])
    error = F.when(F.col("problems").isNull(), "ValueError").otherwise(F.coalesce(F.col("literal.error"), wrong))
    return parsed.select("id", "paragraph", "p.question", "p.choices", "p.answer", "p.question_plus", error.alias("error"))


def submission_path(root: str, artifact: str) -> str:
    """Where the answers of an artifact (a checkpoint's name or path) go."""
    return f"{root.rstrip('/')}/submissions/{artifact.rstrip('/').rpartition('/')[2]}/output.csv"


def write_submissions(predictions: DataFrame, root: str, run_col: str = "run") -> DataFrame:
    """Answers of many runs at once, a folder for each run; returns those of all runs there are.

    A run that was written before is replaced, other runs' answers stay.
    """
    out = predictions.select("id", "answer", F.col(run_col).alias("run"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").csv(f"{root.rstrip('/')}/submissions", header=True, quote='"', escape='"')
    return read_submissions(predictions.sparkSession, root)


def read_submissions(spark: SparkSession, root: str) -> DataFrame:
    """id, answer, run of all runs under root."""
    return spark.read.schema("id string, answer string, run string").csv(f"{root.rstrip('/')}/submissions", header=True, quote='"', escape='"')


def append_log(entries: DataFrame, path: str) -> None:
    """Adds rows (messages, metric values) to a log of JSON lines; nulls are written, other scripts unescaped."""
    entries.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """A configuration as one JSON line, replacing what is there."""
    line = json.dumps(config, ensure_ascii=False, default=str)
    spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_best(best: DataFrame, path: str, metric_name: str, prefix: str = "checkpoint-") -> None:
    """run, step, value of each run's best as JSON lines: run, original_checkpoint, step, metric, metric_name."""
    name = F.concat(F.lit(prefix), F.col("step").cast("string")).alias("original_checkpoint")
    best.select("run", name, "step", F.col("value").alias("metric"), F.lit(metric_name).alias("metric_name")).write.mode("overwrite").json(path)


def metric_series(log: DataFrame) -> DataFrame:
    """name, block, json: each metric's values in order of timestamp, step and value, BLOCK to a block; log
    has name, value, step, timestamp.

    The log is sorted as a whole, so that a busy name spreads, and written with each row's place in its
    part; a name's rows before a part are then summed over the parts, of which there are few.
    """
    log = in_order(log.select("name", "timestamp", "step", "value"), "log", "name", "timestamp", "step", "value")
    parts = log.groupBy("name", "__part").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("name").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("name").alias("of"), "__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    log = log.join(parts, (log["__part"] == parts["__part"]) & log["name"].eqNullSafe(parts["of"]))
    log = log.select("name", "timestamp", "step", "value", F.expr(f"(__at + shift) div {BLOCK}").alias("block"))
    entries = F.array_sort(F.collect_list(F.struct("timestamp", "step", "value")))
    series = F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["step"].alias("step"), e["timestamp"].alias("timestamp")))
    name = F.coalesce("name", F.lit(""))
    return log.groupBy("name", "block").agg(series.alias("series")).select("name", "block", F.to_json(F.map_from_arrays(F.array(name), F.array("series"))).alias("json"))


def metric_rows(logs: DataFrame) -> DataFrame:
    """The inverse: name, value, step, timestamp from a column json."""
    series = logs.select(F.explode(F.from_json("json", LOG)).alias("name", "entries"))
    return series.select("name", F.explode("entries").alias("e")).select("name", "e.value", "e.step", "e.timestamp")
