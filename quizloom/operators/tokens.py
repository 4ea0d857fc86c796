"""A word vocabulary and encoding with it, tokenizers from files, and any other as a function over batches."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quizloom.functions.arrays import attention_mask

SPECIAL = ("<unk>", "<start_of_turn>", "<end_of_turn>")
#: Turn marks, runs of word characters, single other characters.
TOKEN = r"<start_of_turn>|<end_of_turn>|[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]"


#: Bytes of an Arrow batch: Spark and Python hold batches of texts, of tokens and of ids, and an executor has a worker for each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about BATCH_BYTES, or one longer row: rows of long texts fill batches long before their number does."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def build_vocabulary(df: DataFrame, text_col: str, max_size: int = 10_000) -> DataFrame:
    """term, n, id: special tokens first (0 is unknown), then by count. Ranks only max_size rows."""
    counts = df.select(F.explode(tokens(F.col(text_col))).alias("term")).where(~F.col("term").isin(*SPECIAL)).groupBy("term").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(max_size)
    ranked = top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) + len(SPECIAL) - 1).cast("int"))
    fixed = df.sparkSession.createDataFrame([(t, None, i) for i, t in enumerate(SPECIAL)], "term string, n long, id int")
    return fixed.unionByName(ranked)


def encoder(vocabulary: DataFrame) -> Callable[[Column], Column]:
    """Encodes arrays of tokens without a shuffle, in small batches. The vocabulary's size is bounded by build_vocabulary."""
    small_batches(vocabulary.sparkSession)
    terms = [r["term"] for r in vocabulary.orderBy("id").collect()]
    shared = vocabulary.sparkSession.sparkContext.broadcast(terms)

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(shared.value, pa.string())
        for lists in batches:
            ids = pc.fill_null(pc.index_in(lists.flatten(), known), 0).cast(pa.int32())
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), ids)

    # So that a filter by length isn't pushed below it, which would encode (and render) each text twice.
    return encode.asNondeterministic()


class WordTokenizer:
    """A vocabulary of build_vocabulary."""

    def __init__(self, vocabulary: DataFrame) -> None:
        self.vocabulary = vocabulary

    def encode(self, text: Column) -> Column:
        return encoder(self.vocabulary)(tokens(text))

    def ids(self, text: str) -> list[int | None]:
        """Ids of one text, on the driver; null for an unknown token, so that it matches nothing."""
        rows = self.vocabulary.sparkSession.createDataFrame([(text,)], "t string").select(F.posexplode(tokens(F.col("t"))).alias("i", "term"))
        found = rows.join(self.vocabulary, "term", "left").orderBy("i").select("id").collect()
        return [r["id"] for r in found]

    def digest(self) -> str:
        """Tells vocabularies of other words or another order apart."""
        row = self.vocabulary.agg(F.count("*").alias("n"), F.sum(F.xxhash64("term", "id").cast("decimal(38,0)")).alias("h")).first()
        return f"words:{row['n']}:{row['h']}"


class FileTokenizer:
    """A tokenizer in a file of the `tokenizers` library, which every executor can read at the same path.

    Special tokens' strings in a text are ordinary text unless `special` is set.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        self.path, self.special, self._made = path, special, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def made(self):
        from tokenizers import Tokenizer

        if self._made is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
            self._made = Tokenizer.from_file(self.path)
            self._made.encode_special_tokens = not self.special
        return self._made

    def encode(self, text: Column) -> Column:
        own = self
        small_batches(SparkSession.active())

        @F.arrow_udf(ArrayType(IntegerType()))
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                some = (texts.slice(lo, 256).to_pylist() for lo in range(0, len(texts), 256))
                ids = [e.ids for part in some for e in own.made().encode_batch([t or "" for t in part], add_special_tokens=False)]
                yield pa.array(ids, pa.list_(pa.int32()))

        return encode.asNondeterministic()(text)

    def ids(self, text: str) -> list[int]:
        return self.made().encode(text, add_special_tokens=False).ids

    def digest(self) -> str:
        """Of the file's content: the same tokenizer elsewhere has the same."""
        with open(self.path, "rb") as file:
            return f"file:{hashlib.sha256(file.read()).hexdigest()}:{self.special}"


def tokenize(df: DataFrame, text_col: str, encode: Callable[[Column], Column], keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, input_ids and attention_mask."""
    ids = df.withColumn("input_ids", encode(tokens(F.col(text_col))))
    return ids.select(*keep, "input_ids", attention_mask(F.col("input_ids")).alias("attention_mask"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A function over pandas batches, made once per task: an external tokenizer or model. Batches are small."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for batch in batches:
            yield f(batch)

    small_batches(df.sparkSession)
    return df.mapInPandas(rows, schema)


def filter_by_length(df: DataFrame, max_length: int = 1024, ids_col: str = "input_ids") -> DataFrame:
    return df.where(F.size(ids_col) <= max_length)
