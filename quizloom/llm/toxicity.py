"""Toxicity of texts: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

A lexicon of words and of beginnings of words comes from the labels of one half of the sample: what a toxic text has far
more often than a clean one. It has two tiers, plain and slight evidence. The features of a text are densities of either
tier, how many different entries it has, the share of hits with a second person near them, second persons, capitals,
words in capitals, exclamation and question marks, other punctuation, runs of marks, words obfuscated by digits or signs
between their letters, hits among those once read plainly, and the text's length in words. The trees are fitted on
the other half, but for a part of it that calibrates their margins, pooled in steps of STEP before the regression.

The sample is about per_class labelled rows of either class at most, by hash of the id; a class's rows weigh as much as all of
its rows among the labels. Every text is scored, whole.

Nulls: a null text is empty; its score is that of a text without words. Rows with a null label or id are not learnt from;
rows with a null id are in no held-out fold. A document labelled twice is toxic if at least half of its labels are.
Repeated rows are scored alike. Where a part of the sample lacks a class, every score is the share of toxic labels, 0.5
without any labels. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quizloom.llm.common import fold, materialise

#: Words that address a second person.
SECOND = "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split()
#: Signs and digits that stand for letters.
SIGNS = str.maketrans("013457@$!|", "oieastasil")
STEMS, NEAR, STEP = (4, 5, 6), 5, 0.02
FEATURES = "plain slight entries near_second second capitals shouted asking punctuation mark_runs obfuscated plain_read words".split()

_WORD = re.compile(r"[^\W\d_]+")
#: Digits or signs before a letter, and dots or hyphens between single letters.
_MIXED = (re.compile(r"[0-9@$!|*_]+(?=[^\W\d_])"), re.compile(r"[.\-](?=[^\W\d_][.\-][^\W\d_][.\-])"))
_INSIDE, WIDEST = frozenset("@$!|*_.-"), 64
_SHOUT = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}")
_RUN, _RUNS = re.compile(r"[!?]{2,}|\.{3,}|\*{2,}"), ("!!", "??", "!?", "?!", "...", "**")
#: Of the first 256 characters: other than letters as spaces, capitals as small letters; capitals, asking marks, other marks, signs or dots.
_LOWER = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
_KINDS = np.array([[t(chr(c)) for t in (str.isupper, "!?".__contains__, lambda x: not (x.isalnum() or x.isspace() or x in "!?_"), "0123456789@$!|*_.-".__contains__)] for c in range(256)], float)

_CAPITAL = _KINDS[:, 0] > 0


def entries(text: Column) -> Column:
    """Distinct lower-case words of a text and, with an asterisk, their beginnings."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    stems = [F.transform(F.filter(words, lambda w, k=k: F.char_length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def lexicon(texts: DataFrame, size: int = 4000, least: int = 5) -> tuple[list[str], list[str]]:
    """Plain and slight entries of texts (text, label, weight), at most `size` in all.

    An entry has at least `least` toxic texts. Its evidence is the log of how many times likelier a toxic
    text has it, after half a text is added to each count.
    """
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return [], []
    counts = texts.select("label", F.explode(entries(F.col("text"))).alias("entry")).groupBy("entry").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    evidence = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    found = counts.where(F.col("bad") >= least).withColumn("evidence", evidence).where(F.col("evidence") > 2)
    # Frequent, sure entries first.
    found = found.withColumn("z", F.col("evidence") * F.sqrt("bad")).orderBy(F.desc("z"), "entry").limit(size).collect()
    plain = [r["entry"] for r in found if r["bad"] >= max(least, n[1] / 50, 30 * r["good"]) and r["evidence"] > 3]
    return plain, [r["entry"] for r in found if r["entry"] not in set(plain)]


class Reader:
    """Makes the features of texts; a small picklable value."""

    def __init__(self, plain: list[str], slight: list[str]) -> None:
        self.tier = {e: 1 for e in slight} | {e: 0 for e in plain}
        self.second = frozenset(SECOND)
        self.heads = frozenset(e.rstrip("*")[: min(STEMS)] for e in self.tier)

    def hit(self, word: str) -> tuple[int, str] | None:
        """The surest entry that the word has: tier and entry."""
        found = [(self.tier[e], e) for e in (word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)) if e in self.tier]
        return min(found) if found else None

    def hits(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Place, tier and entry of each word that has one."""
        heads, size = self.heads, min(STEMS)
        some = {w: h for w in [w for w in set(words) if w[:size] in heads] if (h := self.hit(w))}
        return [(i, *some[w]) for i, w in enumerate(words) if w in some] if some else []

    def features(self, text: str) -> list[float]:
        raw = text.encode("latin-1", "ignore")
        words = raw.translate(_LOWER).decode("latin-1").split() if len(raw) == len(text) else _WORD.findall(text.lower())
        n, length = len(words), len(text)
        if not n:
            return [0.0] * len(FEATURES)
        codes = np.frombuffer(raw, np.uint8)
        capitals, asking, marks, signs = (np.bincount(codes, minlength=256) @ _KINDS).tolist()
        large = _CAPITAL[codes]
        shouted = len(_SHOUT.findall(text)) if capitals >= 3 and (large[:-2] & large[1:-1] & large[2:]).any() else 0
        runs = len(_RUN.findall(text)) if any(r in text for r in _RUNS) else 0
        hits = self.hits(words)
        plain = [(i, e) for i, tier, e in hits if tier == 0]
        near = sum(not self.second.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i, _ in plain)
        mixed = self.mixed(text.lower()) if signs else []
        read = [self.hit(re.sub(r"[*.\-_]", "", m.translate(SIGNS))) for m in mixed]
        return [
            100.0 * len(plain) / n, 100.0 * (len(hits) - len(plain)) / n, float(np.log1p(len({e for _, e in plain}))), near / max(len(plain), 1),
            100.0 * sum(map(self.second.__contains__, words)) / n, capitals / length, shouted / n,
            100.0 * asking / length, 100.0 * marks / length, 100.0 * runs / n,
            100.0 * len(mixed) / n, 100.0 * sum(h is not None and h[0] == 0 for h in read) / n, float(np.log1p(n)),
        ]

    def mixed(self, text: str) -> list[str]:
        """Words with signs inside, and what stands around them without a space, WIDEST characters to a side at most."""
        out, end = [], 0
        for found in sorted((f for p in _MIXED for f in p.finditer(text) if f.start() and text[f.start() - 1].isalpha()), key=re.Match.start):
            if found.start() >= end:
                a, b = found.span()
                while a > max(0, found.start() - WIDEST) and (text[a - 1].isalnum() or text[a - 1] in _INSIDE):
                    a -= 1
                while b < min(len(text), found.end() + WIDEST) and (text[b].isalnum() or text[b] in _INSIDE):
                    b += 1
                out.append(text[a:b])
                end = b
        return out


def with_features(docs: DataFrame, reader: Reader, text_col: str = "text", features_col: str = "features") -> DataFrame:
    """docs with an array of doubles, in the order of FEATURES."""
    shared = docs.sparkSession.sparkContext.broadcast(reader)

    @F.arrow_udf(ArrayType(DoubleType()))
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shared.value.features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    return docs.withColumn(features_col, made(F.col(text_col)))


def sample(labels: DataFrame, id_col: str, label_col: str, learn: Column | None, per_class: int) -> tuple[DataFrame, float]:
    """id, label, weight, part of about per_class rows a class at most; the share of toxic ones among all (0.5 of none)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    share = lambda c: min(1.0, per_class / max(n.get(c, 0), 1))
    place = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)).alias("place")
    rate = F.when(F.col("label") == 1, F.lit(share(1))).otherwise(F.lit(share(0)))
    rows = known.withColumn("place", place).where(F.col("place") < rate)
    # One half makes the lexicon; of the other, seven tenths make the trees.
    cut = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(20))
    part = F.when(cut < 10, "lexicon").when(cut < 17, "trees").otherwise("calibration").alias("part")
    return rows.select("id", "label", (1 / rate).alias("weight"), part), (n.get(1, 0) / total if total else 0.5)


class Model:
    """What scores features: trees and calibration, or a constant."""

    def __init__(self, share: float, trees=None, calibration=None) -> None:
        self.share, self.trees, self.calibration = share, trees, calibration

    def margin(self, rows: DataFrame, features_col: str) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = self.trees.transform(rows.withColumn("__x", array_to_vector(features_col)))
        return rows.withColumn("__margin", vector_to_array("rawPrediction")[1]).drop("__x", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame, features_col: str = "features", score_col: str = "score") -> DataFrame:
        if self.trees is None:
            return rows.withColumn(score_col, F.lit(float(self.share)))
        rows = self.calibration.transform(self.margin(rows, features_col))
        return rows.withColumn(score_col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score")))).drop("__margin", "__score")


def fit(rows: DataFrame, share: float, trees: int = 20, depth: int = 3, seed: int = 7) -> Model:
    """Fits rows: features, label, weight, part."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    seen = {(r["part"], r["label"]) for r in rows.select("part", "label").distinct().collect()}
    if not seen >= {(p, c) for p in ("trees", "calibration") for c in (0, 1)}:
        return Model(share)
    grown = GBTClassifier(featuresCol="__x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed)
    model = Model(share, grown.fit(rows.where("part = 'trees'").withColumn("__x", array_to_vector("features"))))
    steps = model.margin(rows.where("part = 'calibration'"), "features").groupBy((F.round(F.col("__margin") / STEP) * STEP).alias("__margin"))
    steps = steps.agg((F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight"))
    model.calibration = IsotonicRegression(featuresCol="__margin", labelCol="label", weightCol="weight", predictionCol="__score").fit(steps)
    return model


def with_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, per_class: int = 20_000, score_col: str = "score") -> DataFrame:
    """docs, without the text, with score_col: the calibrated likelihood, 0 to 1, that a text is toxic."""
    rows, share = sample(labels, id_col, label_col, learn, per_class)
    rows = materialise(rows, "sample")
    # The sample is bounded by per_class, so it can be sent to every task.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows.where("part = 'lexicon'")), "id")
    reader = Reader(*lexicon(texts))
    made = with_features(docs.select(F.struct(*(c for c in docs.columns if c != text_col)).alias("others"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), reader)
    made = materialise(made.drop("text"), "features")
    model = fit(materialise(made.join(F.broadcast(rows), "id").select("features", "label", "weight", "part"), "learnt"), share)
    scored = model.score(made, "features", "__score_of")
    return scored.select(*(F.col(f"others.`{c}`").alias(c) for c in docs.columns if c != text_col), F.col("__score_of").alias(score_col))


def learnable(id_col: str = "doc_id") -> Column:
    """Not in the held-out fold."""
    return fold(F.col(id_col), 5) != 0
