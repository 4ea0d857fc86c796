"""Substring dedup with suffix automata of reference shards.

A window is `window` consecutive words. A window is removed where its word sequence also starts in
a document with a smaller id. Every window chooses an anchor by its content alone: the smallest
hash among its runs of `gram` words. So equal windows, wherever they stand, choose equal anchors
and meet in one shard. Only anchors that occur in several documents are followed: a bit table of
bounded size says which may be.

Neighbouring windows with the same anchor form a segment. For each distinct segment the smallest
document is found by an aggregation of hashes, so thousands of copies of a passage are one row from
there on, and any later document with the same segment loses all of it. A shard is an anchor's
distinct segments where they differ; their words are fetched then, once each, by a bit table of who is
to send them. In order of their documents they are streamed through the shard's suffix automaton, which
holds the segments of smaller documents, and where the matching statistic reaches the window's length
that window is repeated. Then the segment joins the automaton. A busy anchor is split: each of its
windows is a segment of its own, in a shard chosen by the window.

The automata are built where a shard's segments meet rather than sent to all executors, since the
reference grows with the input and a broadcast may not; the bit tables are broadcast.

Nulls: a null text has no words; rows with a null id have no smaller or larger document, so they
lose nothing and remove nothing. Rows that repeat an id are one document. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm.common import bit_table, gram_hashes, has_bit, id_table, lean, materialise, may_hold, mix, split_words, table_bits, text_chunks, tidy, word_hashes

BUSY = 1000
SEGMENT = 64


class SuffixAutomaton:
    """A generalised suffix automaton over words, with matching statistics."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[str]) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nexts[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in nexts[p]:
                    nexts[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][w]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
                last = new
            else:
                last = self._clone(last, w, q)

    def _clone(self, p: int, w: str, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        twin = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = twin
            p = link[p]
        return twin

    def statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest run ending there that the automaton holds."""
        nexts, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                n = length[state]
            to = nexts[state].get(w)
            state, n = (0, 0) if to is None else (to, n + 1)
            out.append(n)
        return out


def window_anchors(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (word), row and anchor of every window."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    grams = gram_hashes(words, gram)
    least, width, need = grams, 1, window - gram + 1
    while width < need:
        step = min(width, need - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
    return starts, row[starts], least[starts]


def anchor_rows(window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo, _, data, offsets in text_chunks(batch.column("text")):
                starts, ends, first = split_words(data, offsets)
                _, row, anchor = window_anchors(word_hashes(data, starts, ends), first, window, gram)
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.empty(0, np.int64)
                yield pa.record_batch({"anchor": pa.array(anchor[new].view(np.int64)), "id": pa.array(ids[lo:][row[new]])})

    return lean(rows)


def _wanted(digest: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What the bit table of wanted segments is asked for: the digest, xor the id turned left by 40 bits."""
    return digest ^ (ids << np.uint64(40) | ids >> np.uint64(24))


def segment_rows(window: int, gram: int, shared, busy, wanted=None):
    """Segments of windows whose anchor may be in several documents; with wanted, the words of those wanted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(c).to_numpy() for c in ("id", "version"))
            for lo, _, data, offsets in text_chunks(batch.column("text")):
                starts, ends, first = split_words(data, offsets)
                words = word_hashes(data, starts, ends)
                at, row, anchor = window_anchors(words, first, window, gram)
                if not len(at):
                    continue
                keep = has_bit(shared.value, anchor)
                at, row, anchor = at[keep], row[keep], anchor[keep]
                if not len(at):
                    continue
                single = has_bit(busy.value, anchor)
                whole = gram_hashes(words, window)[at]
                new = np.r_[True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | single[1:]]
                begin = np.flatnonzero(new)
                size = np.diff(np.r_[begin, len(at)])
                if size.max() > SEGMENT:  # a run of one repeated passage: any cut will do
                    pos = np.arange(len(at)) - np.repeat(begin, size)
                    begin = np.flatnonzero(new | (pos % SEGMENT == 0))
                    size = np.diff(np.r_[begin, len(at)])
                key = np.where(single[begin], mix(anchor[begin] ^ whole[begin]), anchor[begin])
                with np.errstate(over="ignore"):
                    digest = mix(np.add.reduceat(mix(whole ^ mix(at.astype(np.uint64) - np.repeat(at[begin], size).astype(np.uint64))), begin))
                s, n, of = at[begin], size + window - 1, row[begin]
                own = ids[lo:][of]
                if wanted:
                    keep = np.flatnonzero(has_bit(wanted.value, _wanted(digest, own.astype(np.uint64))))
                    # A passage that a document repeats is sent once.
                    keep = np.sort(keep[np.unique(mix(digest[keep] ^ mix(own[keep].astype(np.uint64))), return_index=True)[1]])
                    d = data.tobytes()
                    text = [b" ".join(d[starts[a] : ends[a + m - 1]].split()).decode() for a, m in zip(s[keep], n[keep])]
                    yield pa.record_batch({"key": pa.array(key[keep].view(np.int64)), "digest": pa.array(digest[keep].view(np.int64)), "first": pa.array(own[keep]), "words": pa.array(text, pa.string())})
                    continue
                yield pa.record_batch(
                    {
                        "key": pa.array(key.view(np.int64)),
                        "digest": pa.array(digest.view(np.int64)),
                        "id": pa.array(own),
                        "version": pa.array(versions[lo:][of]),
                        "start": pa.array((s - first[of]).astype(np.int32)),
                        "n": pa.array(n.astype(np.int32)),
                    }
                )

    return lean(rows)


def shard_rows(window: int):
    """Streams each shard's segments, smallest document first, through the shard's automaton.

    Returns for each segment that has any the word ranges, from its start, that are repeated in its first document.
    """
    kind = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("first", pa.int64()), ("froms", pa.list_(pa.int32())), ("tos", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, waiting, owner, last = None, None, [], None, None
        for batch in batches:
            out: list[tuple] = []
            for k, digest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "first", "words"))):
                if (k, digest, doc) == last:  # again in the same document
                    continue
                last, words = (k, digest, doc), text.split(" ")
                if k != key:
                    key, automaton, waiting, owner = k, None, [], doc
                elif doc != owner:
                    automaton = automaton or SuffixAutomaton()
                    for other in waiting:
                        automaton.add(other)
                    waiting, owner = [], doc
                a, b = [], []
                if automaton:
                    for i, n in enumerate(automaton.statistics(words)):
                        if n >= window:
                            if b and i - window + 1 <= b[-1]:
                                b[-1] = i + 1
                            else:
                                a.append(i - window + 1)
                                b.append(i + 1)
                waiting.append(words)
                if a:
                    out.append((k, digest, doc, a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 5, kind)], schema=kind)

    return lean(rows)


@tidy
def removed_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, version, froms, tos: the word ranges that each document loses; docs has id, version, text."""
    sc = docs.sparkSession.sparkContext
    docs = docs.where("id is not null")
    anchors = docs.select("id", "text").mapInArrow(anchor_rows(window, gram), "anchor long, id long")
    anchors = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    anchors = materialise(anchors.select("anchor", "n"), "anchors")
    shared, busy = (sc.broadcast(bit_table(x, "anchor", table_bits(x.count()))) for x in (anchors, anchors.where(F.col("n") > BUSY)))
    segments = docs.mapInArrow(segment_rows(window, gram, shared, busy), "key long, digest long, id long, version long, start int, n int")
    segments = materialise(segments, "segments")
    distinct = segments.groupBy("key", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # A key has no more than some BUSY segments, or one window's.
    whole = Window.partitionBy("key")
    differ = (F.count("*").over(whole) > 1) & (F.min("first").over(whole) < F.max("first").over(whole))
    distinct = materialise(distinct.withColumn("differ", differ).where("differ or first < last"), "distinct")
    turned = F.shiftleft("first", 40).bitwiseOR(F.shiftrightunsigned("first", 24))
    some = distinct.where("differ")
    wanted = sc.broadcast(bit_table(some.select(F.col("digest").bitwiseXOR(turned).alias("h")), "h", table_bits(some.count())))
    words = docs.mapInArrow(segment_rows(window, gram, shared, busy, wanted), "key long, digest long, first long, words string")
    shards = materialise(words, "words").repartition("key").sortWithinPartitions("key", "first", "digest")
    shards = materialise(shards.mapInArrow(shard_rows(window), "key long, digest long, first long, froms array<int>, tos array<int>"), "shards")
    distinct = distinct.join(shards, ["key", "digest", "first"], "left").where("first < last or froms is not null")
    spans = segments.join(distinct, ["key", "digest"])
    later = F.col("id") > F.col("first")
    ends = lambda c, one: F.when(later, F.array(one)).otherwise(F.transform(c, lambda x: x + F.col("start")))
    spans = spans.select("id", "version", ends("froms", F.col("start")).alias("froms"), ends("tos", F.col("start") + F.col("n")).alias("tos")).where(F.size("froms") > 0)
    return spans.groupBy("id", "version").agg(F.flatten(F.collect_list("froms")).alias("froms"), F.flatten(F.collect_list("tos")).alias("tos"))


def kept_words(words: list[bytes], froms, tos) -> list[bytes]:
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, froms, 1)
    np.add.at(change, tos, -1)
    return [w for w, k in zip(words, np.cumsum(change[:-1]).tolist()) if not k]


def untouched(table, text: str):
    """Rows whose id isn't in the table lose nothing."""
    remove = removing(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~has_bit(table.value, batch.column("__h").to_numpy().view(np.uint64)))).drop_columns(["__h"])
            none = pa.nulls(rest.num_rows, pa.list_(pa.int32()))
            yield from remove([pa.RecordBatch.from_arrays([*rest.columns, none, none], [*rest.schema.names, "__froms", "__tos"])])

    return lean(rows)


def removing(text: str):
    """Rows with kept, n_words and n_removed by the spans of the column text that they lose."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, max(1, whole.num_rows), 500)):
            keep, count, less = [], [], []
            for t, froms, tos in zip(batch.column(text), batch.column("__froms"), batch.column("__tos")):
                words = (t.as_py() or "").encode().split()
                left = kept_words(words, np.asarray(froms.values), np.asarray(tos.values)) if froms.is_valid and len(words) else words
                keep.append(b" ".join(left).decode())
                count.append(len(words))
                less.append(len(words) - len(left))
            own = [c for c in batch.schema.names if c not in ("__froms", "__tos")]
            columns = [*(batch.column(c) for c in own), pa.array(keep, pa.string()), pa.array(count, pa.int64()), pa.array(less, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*own, "kept", "n_words", "n_removed"])

    return lean(rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 6) -> DataFrame:
    """docs with kept (the words left, joined by one space), n_words and n_removed; other own columns of these names are replaced."""
    version = F.xxhash64(text_col)
    bare = docs.select(F.col(id_col).cast("long").alias("id"), version.alias("version"), F.col(text_col).alias("text"))
    spans = removed_spans(bare, window, gram).toDF("__id", "__version", "__froms", "__tos")
    docs = docs.drop(*({"kept", "n_words", "n_removed"} - {id_col, text_col}))
    rows = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_version": version})
    # Only documents that may lose words go through the exchange of the join.
    table = id_table(spans, "__id")
    fits = (F.col("__row_id") == F.col("__id")) & (F.col("__row_version") == F.col("__version"))
    losing = materialise(rows.where(may_hold(table, "__row_id")), "losing")
    losing = losing.join(spans, fits, "left").select(*docs.columns, "__froms", "__tos")
    rest = rows.select(*docs.columns, F.xxhash64("__row_id").alias("__h"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "kept string, n_words long, n_removed long"])
    return losing.mapInArrow(removing(text_col), schema).unionByName(rest.mapInArrow(untouched(table, text_col), schema))
