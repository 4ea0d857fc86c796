"""Missing values, length histogram, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.sources.mcq import written

#: Runs of two word characters or more, in every script.
TERM = r"[\p{L}\p{M}\p{N}\p{Pc}]{2,}"


def missing_values(df: DataFrame) -> DataFrame:
    """column, n_missing, in one pass; NaN counts as missing."""
    lacking = lambda f: F.col(f.name).isNull() | (F.isnan(f.name) if f.dataType.typeName() in ("double", "float") else F.lit(False))
    counts = df.agg(*(F.count_if(lacking(f)).alias(f.name) for f in df.schema))
    return counts.unpivot([], counts.columns, "column", "n_missing")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high, n of equal-width bins, empty ones too; the last is closed on the right."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (float(lo), float(hi))
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(column) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, "bin", "left")
    return out.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def all_terms(text_col: str) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), F.lit(0)))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf."""
    return df.select(F.col(id_col).alias("id"), all_terms(text_col).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def frequent_counts(df: DataFrame, id_col: str, text_col: str, max_features: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The most frequent terms (term, ctf; ties by term) and their counts in each document (id, term, tf), written.

    The terms have max_features rows at most, so they are broadcast, and other terms pass no exchange with an id.
    """
    terms = df.select(all_terms(text_col).alias("term")).groupBy("term").agg(F.count("*").alias("ctf"))
    top = written(terms.orderBy(F.desc("ctf"), "term").limit(max_features), "terms")
    known = df.select(F.col(id_col).alias("id"), all_terms(text_col).alias("term")).join(F.broadcast(top.select("term")), "term")
    return top, written(known.groupBy("id", "term").agg(F.count("*").alias("tf")), "counts")


def tfidf_vocabulary(df: DataFrame, id_col: str, text_col: str, max_features: int = 1000) -> DataFrame:
    """term, ctf, df of the most frequent terms; ties by term."""
    top, counts = frequent_counts(df, id_col, text_col, max_features)
    return top.join(document_counts(counts), "term").orderBy(F.desc("ctf"), "term")


def document_counts(counts: DataFrame) -> DataFrame:
    """term, df."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def weighted(counts: DataFrame, n: int) -> DataFrame:
    """id, term, weight from the counts of a vocabulary's terms in n documents."""
    known = counts.join(F.broadcast(document_counts(counts)), "term")
    w = F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    # A document has max_features rows at most. Counts pass the exchange, weights are made behind it.
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("id")))
    return known.select("id", "term", (w / norm).alias("weight"))


def tfidf(df: DataFrame, id_col: str, text_col: str, max_features: int = 1000) -> DataFrame:
    """id, term, weight: tf * (ln((1 + N) / (1 + df)) + 1), of length 1 per document.

    Documents without a term of the vocabulary have no rows; those of one id count as one text, and so do those without an id.
    """
    return weighted(frequent_counts(df, id_col, text_col, max_features)[1], df.count())


def tfidf_wide(weights: DataFrame, terms: list[str], ids: DataFrame, limit: int = 1000) -> DataFrame:
    """A row per row of ids (id), a column per term in alphabetical order; for at most `limit` terms.

    A document without any of the terms has a row of zeros. A null id is an id like any other.
    """
    if len(terms) > limit:
        raise ValueError(f"{len(terms)} terms; a wide frame holds {limit} at most")
    wide = weights.groupBy(F.col("id").alias("__id")).pivot("term", sorted(terms)).agg(F.sum("weight"))
    ids = ids.select("id")
    return ids.join(wide, ids["id"].eqNullSafe(wide["__id"]), "left").drop("__id").fillna(0.0, subset=sorted(terms))
