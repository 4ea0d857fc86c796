"""Evaluation logs: running best, final best, artifacts. Logs have run, step, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.sources.mcq import in_order


def running_best(log: DataFrame, greater_is_better: bool = False) -> DataFrame:
    """log with best_before and is_best: strictly better than all earlier values of the run; nulls never are.

    Rows go by step, those of one step as they stand in the log; null steps come first. The log is sorted as a
    whole into even parts. The best of each run and part is accumulated over the parts, of which there are few, and only
    inside a part are rows gone through, so a long run spreads, whatever its steps are.
    """
    best, better_of = (F.max, F.greatest) if greater_is_better else (F.min, F.least)
    rows = in_order(log, "evaluations", "run", "step")
    before = Window.partitionBy("__run").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    bests = rows.groupBy(F.col("run").alias("__run"), F.col("__part").alias("__in")).agg(best("value").alias("__best"))
    bests = bests.withColumn("__base", best("__best").over(before)).where("__base is not null").drop("__best")
    past = Window.partitionBy("run", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__past", best("value").over(past))
    # A row per run and part that goes on from an earlier one: hardly more than parts and runs.
    rows = rows.join(bests, rows["run"].eqNullSafe(bests["__run"]) & (rows["__part"] == bests["__in"]), "left")
    rows = rows.select(*log.columns, better_of("__base", "__past").alias("best_before"))
    better = F.col("value") > F.col("best_before") if greater_is_better else F.col("value") < F.col("best_before")
    return rows.withColumn("is_best", F.col("value").isNotNull() & (F.col("best_before").isNull() | better))


def improvements(log: DataFrame, greater_is_better: bool = False) -> DataFrame:
    """run, step, value, n_improvements: the last improvement of a run is its best, so one pass gives both.

    A run without any value has nulls and no improvements.
    """
    rows = running_best(log.select("run", "step", "value"), greater_is_better)
    last = F.max_by if greater_is_better else F.min_by
    best = last(F.struct("step", "value"), F.when(F.col("is_best"), F.col("value")))
    return rows.groupBy("run").agg(best.alias("b"), F.count_if("is_best").alias("n_improvements")).select("run", "b.step", "b.value", "n_improvements")


def final_best(log: DataFrame, greater_is_better: bool = False) -> DataFrame:
    """run, step, value of each run's best, the earliest on ties: a plain aggregate. Null if all are."""
    sign = -1 if greater_is_better else 1
    key = F.when(F.col("value").isNotNull(), F.struct((F.col("value") * sign).alias("v"), F.col("step").alias("s")))
    best = log.groupBy("run").agg(F.min_by(F.struct("step", "value"), key).alias("b"))
    return best.select("run", "b.step", "b.value")


def suffix(name: Column) -> Column:
    """The number after the first hyphen; null if it isn't one."""
    return F.try_element_at(F.split(name, "-"), F.lit(2)).try_cast("long")


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    """name, step of the largest suffix; one row, of nulls where no name has a number."""
    return artifacts.agg(F.max_by("name", suffix(F.col("name"))).alias("name"), F.max(suffix(F.col("name"))).alias("step"))


def require_latest(artifacts: DataFrame) -> str:
    name = latest_artifact(artifacts).first()["name"]
    if name is None:
        raise FileNotFoundError("no artifact with a numeric suffix")
    return name


def ordered_artifacts(artifacts: DataFrame) -> DataFrame:
    """By suffix, names without one first."""
    return artifacts.select("name", F.coalesce(suffix(F.col("name")), F.lit(0)).alias("step")).orderBy("step", "name")


def levels(messages: DataFrame) -> DataFrame:
    return messages.groupBy("level").agg(F.count("*").alias("n"))


def iso_stamp(ts: Column) -> Column:
    """A timestamp as in ISO 8601; microseconds only where there are any."""
    fraction = F.when(F.date_format(ts, "SSSSSS") != "000000", F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def log_entry(message: Column, level: Column | str = "INFO", ts: Column | None = None) -> Column:
    """timestamp, level, message; a null level is INFO. Stamped with the query's time unless ts is given."""
    level = F.lit(level) if isinstance(level, str) else level
    stamp = iso_stamp(F.current_timestamp() if ts is None else ts)
    return F.struct(stamp.alias("timestamp"), F.coalesce(level, F.lit("INFO")).alias("level"), message.alias("message"))


def run_name(ts: Column) -> Column:
    """A run's default name."""
    return F.concat(F.lit("exp_"), F.date_format(ts, "yyyyMMdd_HHmmss"))
