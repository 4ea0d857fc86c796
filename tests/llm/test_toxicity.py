import random

import pytest
from pyspark.sql import functions as F

from quizloom.llm import toxicity
from quizloom.llm.common import fold

SCHEMA = "doc_id long, text string, score string, features int, label int"


def corpus(n=600, seed=2):
    """Texts of made-up words, a fifth of them with some of five others; no text has only those."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bdglmnr") + rng.choice("aeiou") for _ in range(3)) for _ in range(80)]
    rude = ["zorkface", "grumbel", "quibber", "splotz", "vexling"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words), "x", 1, 1))
        labels.append((i, int(toxic)))
    return rows, labels


def scores(spark, rows, labels, **more):
    out = toxicity.with_score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), score_col="s", **more)
    assert out.columns == ["doc_id", "score", "features", "label", "s"]
    return out.collect()


def test_held_out_texts(spark):
    rows, labels = corpus()
    rows += [(10_000, None, "x", 1, 1), (10_001, "", "x", 1, 1), (10_002, "zorkface " * 200_000, "x", 1, 1), (None, rows[5][1], None, None, None), (0, rows[0][1], "x", 1, 1), (0, rows[0][1], "x", 1, 1)]
    labels += [(3, None), (None, 1), (777_777, 1)]
    found = scores(spark, rows, labels, learn=toxicity.learnable())
    assert len(found) == len(rows) and all(0 <= r["s"] <= 1 for r in found)
    by_id = {r["doc_id"]: r["s"] for r in found}
    held = [r["doc_id"] for r in spark.range(600).select(F.col("id").alias("doc_id")).where(fold(F.col("doc_id"), 5) == 0).collect()]
    assert len(held) > 60 and sum((by_id[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert by_id[10_000] == by_id[10_001] < 0.5 <= by_id[10_002]
    assert len({r["s"] for r in found if r["doc_id"] == 0}) == 1


def test_labels_held_out_are_never_used(spark):
    rows, labels = corpus(300)
    held = {r["id"] for r in spark.range(300).where(fold(F.col("id"), 5) == 0).collect()}
    turned = [(i, 1 - t if i in held else t) for i, t in labels]
    first, other = ({r["doc_id"]: r["s"] for r in scores(spark, rows, some, learn=toxicity.learnable())} for some in (labels, turned))
    assert first == pytest.approx(other)


def test_too_few_labels(spark):
    rows, labels = corpus(30)
    assert {r["s"] for r in scores(spark, rows, [])} == {0.5}
    assert {r["s"] for r in scores(spark, rows, [(1, 0), (1, 1), (2, 0)])} == {0.5}  # labelled twice: toxic
    assert {r["s"] for r in scores(spark, rows, [(1, 0), (2, 0)])} == {0.0}
    assert scores(spark, [], labels) == []


def test_the_sample_is_bounded(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    rows, share = toxicity.sample(labels, "doc_id", "toxic", None, 1000)
    n = {r["label"]: (r["n"], r["w"]) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert share == 0.25 and all(850 < n[c][0] < 1150 for c in n) and n[1][1] == pytest.approx(5000, rel=0.15) and n[0][1] == pytest.approx(15_000, rel=0.15)


def test_features():
    reader = toxicity.Reader(["idiot", "lowei*"], ["loser"])
    at = lambda text: dict(zip(toxicity.FEATURES, reader.features(text)))
    plain = at("You are an idiot, loweisch! The LOSER is idiotic")
    assert plain["plain"] == pytest.approx(100 * 2 / 9) and plain["slight"] == pytest.approx(100 / 9) and plain["near_second"] == 1 and plain["shouted"] == pytest.approx(1 / 9)
    assert at("an idiot sat far from all of the people there, as you see")["near_second"] == 0
    assert at("such an 1d10t and id.i.ot")["plain_read"] > 0 and at("such an 1d10t")["obfuscated"] > 0
    assert at("Idiot Idiot")["plain"] == 100 and at("?!?! x")["mark_runs"] > 0
    assert set(reader.features("")) == set(reader.features("... 12 !")) == {0.0}
