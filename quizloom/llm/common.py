"""What several operators share: tables in the shared folder, word and shingle hashes over
Arrow text, bounded bit tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once; longer texts are taken in parts, so that temporary arrays stay small.
HASHED = 1 << 17
_own: dict[str, str] = {}
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is set (tests), one in the temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        _own[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quizloom/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is written: texts are long, and Spark and Python hold a batch each.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> str:
    """From now on Arrow batches have BATCH_ROWS rows at most; returns the setting there was."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(setting)
    spark.conf.set(setting, str(min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS))
    return rows


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    if (written := _tables.get()) is not None:
        written.append(path)
    rows = small_batches(df.sparkSession)
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables() -> Iterator[list[str]]:
    """The paths of the tables that materialise writes meanwhile, but for those of tidy operators inside."""
    own: list[str] = []
    outer = _tables.set(own)
    try:
        yield own
    finally:
        _tables.reset(outer)


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written as a table, after which the tables that led to it go.

    Only tables that this call wrote are removed, and only once nothing has to be recomputed from them.
    """

    @functools.wraps(operator)
    def tidied(*args, **named) -> DataFrame:
        with tables() as own:
            result = operator(*args, **named)
        result = materialise(result, operator.__name__)
        remove(result.sparkSession, own)
        return result

    return tidied


def give_back() -> None:
    """Gives free memory back to the system: Spark keeps its Python workers, and what they hold counts against an
    executor's other steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: By step, what a worker remembers of it from task to task.
_remembered: dict[str, dict] = {}


def remembered(step: str) -> dict:
    """What a worker remembers of a step from task to task, until it runs another step."""
    return _remembered.setdefault(step, {})


def forget(but: str | None = None) -> None:
    """Lets go of what the worker remembers of other steps: Spark hands its workers on from step to step."""
    others = [held for step, held in _remembered.items() if step != but and held]
    for held in others:
        held.clear()
    if others:
        give_back()


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], step: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that keeps no other step's memory, and gives a task's free memory back when it ends."""

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(step)
        yield from rows(batches)
        give_back()

    return run


def fold(of: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null ids fall in no fold."""
    return F.crc32(of.cast("string").cast("binary")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their UTF-8 bytes end to end, and each row's offset there; nulls are empty.

    A chunk holds about limit bytes, or one longer row, so temporary arrays stay small.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each row's first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]  # rows end words, too
    begins[cut] = word[cut]
    stops[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(HASHED, base, np.uint64)], dtype=np.uint64) for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))


def _long_word(data: np.ndarray) -> np.uint64:
    """The polynomial of one word of any length."""
    total = 0
    with np.errstate(over="ignore"):
        for at in range(0, len(data), HASHED):
            part = data[at : at + HASHED].astype(np.uint64) + np.uint64(1)
            total += int((part * _powers()[0][: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    return np.uint64(total & 0xFFFFFFFFFFFFFFFF)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial by prefix sums, then mixed with its length."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        up, down = _powers()
        while i < len(starts):
            lo = int(starts[i])
            j = int(np.searchsorted(ends, lo + HASHED, "right"))
            if j <= i:
                out[i] = _long_word(data[lo : ends[i]])
                i += 1
                continue
            part = data[lo : ends[j - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
            i = j
        return mix(out + (ends - starts).astype(np.uint64) * _STEP)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; those over a row's end are the caller's to drop."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * _STEP + words[i : i + n]
        return mix(out)


#: Counters that a task holds before it passes them on.
HELD = 1_000_000


class Counter:
    """Sums of keys, as sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        keys, n = keys[at], (np.add.reduceat(n, at) if len(at) else n)
        self.parts, self.size = [(keys, n)], len(keys)
        return keys, n


BITS = 27


def bit_table(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A table of 2**bits bits (16 MB at 27) with the bit of each key's top bits set.

    Its size is fixed, so it can be broadcast whatever the input; as keys grow it lets more
    others through, which costs work downstream and changes no result.
    """
    rows = (
        keys.select(F.shiftrightunsigned(column, 64 - bits).alias("at"))
        .select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    found = rows.toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (len(table).bit_length() - 1 + 6))
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def table_bits(n: int) -> int:
    """64 bits a key or more, 2**BITS at most."""
    return min(BITS, max(16, (64 * n).bit_length()))


def id_table(ids: DataFrame, column: str):
    """A broadcast bit table of the column's ids, hashed by xxhash64: 64 bits an id or more, 2**BITS at most.

    What passes it are all those ids and few others, so it keeps rows that a join would drop out of
    the exchange before it; the join decides.
    """
    return ids.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64(column).alias("h")), "h", table_bits(ids.count())))


def may_hold(table, of: str) -> Column:
    """Whether the id may be in an id_table. Not for a plan with other Python steps in the same
    stage, where each task would start workers for both: test the hashes there."""

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        return pa.array(has_bit(table.value, h.to_numpy().view(np.uint64)))

    return held(F.xxhash64(of))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) for every id that has an edge.

    Labels take the neighbours' minimum and then their label's own label, so paths halve and
    rounds grow with the logarithm of a component's width. Labels are a written table each round;
    both joins have an exchange on either side, which lets Spark split a hot id.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("component").alias("m"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        taken = labels.join(far, "component").select(F.col("id").alias("u"), F.col("component").alias("old"), "beyond")
        new = materialise(
            taken.join(near, "u").select(F.col("u").alias("id"), F.least("beyond", "m").alias("component"), (F.least("beyond", "m") < F.col("old")).alias("moved")),
            "labels",
        )
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels
