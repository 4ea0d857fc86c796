"""Groups of spelling variants: words, their near words, the form that most likely is meant, and its root.

Words are counted over all texts. Two words are near if they differ by exactly one inserted, deleted or
replaced letter. The index is bit-sliced: for each position and letter there is a bitset over the words, 64 to
a machine word. A query word runs along its letters; with each one, three bitsets are updated for all words at
once: those that agree so far without an error, those with one replaced letter, and those with one more letter,
which are looked up at the next position.

Words that can't be near needn't meet. Of a pair whose shorter word has n letters, the first letter that
differs lies in the first or in the second half of the n places; all letters before and after that half are
equal, counted from either end. So a word goes into a shard for each half, by the other half's letters, and for
either part it may have in a pair (shorter or not). A shard of more than LARGE words is cut again: its words
go to two shards with half the window, down to a window of one place, where a shard has no more words than there are letters
to put there. A pair counts only where its first differing place lies in the shard's window, so it counts once.
A task reads whole shards one after the other; no pairs leave it, only a row a word: how many are near, and the best.

Nulls: a null text has no words; a null id is empty in `<id>:<run>`. Runs are cut from whole texts. Empty tables give
no rows. Extra columns are ignored; repeated rows count again. Words of any length take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm.common import lean, materialise, tidy

#: Letters of a run, as Java and RE2 read them.
LETTERS = r"A-Za-z\x{00C0}-\x{00FF}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shard beyond which it is cut; words that a task holds at once, and query rows that it runs at once.
LARGE, HELD, RUN = 4096, 1 << 16, 1 << 18
KEY = ("short", "lo", "hi", "key")


def runs(text: Column, least: int) -> Column:
    """Maximal runs of at least so many letters, A-Z in lower case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def worn(run: Column, id_: Column, every: int = 31) -> Column:
    """The run, less a letter if `every` divides the crc32 of `<id>:<run>`: its place is that number's, too."""
    h = F.crc32(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, times: int = 2) -> DataFrame:
    """word, n: words of at least `least` letters that occur at least `times` times."""
    word = worn(F.col("run"), F.col("id")).alias("word")
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col), least)).alias("run")).select(word)
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def windows(lo: Column, hi: Column) -> Column:
    """The two halves of the places lo to hi."""
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def sharded(rows: DataFrame) -> DataFrame:
    """rows (word, n, short, windows) by window; key: what stands before it and after it."""
    rows = rows.select("word", "n", "short", F.explode("windows").alias("w")).select("word", "n", "short", "w.lo", "w.hi")
    after = F.col("short") - F.col("hi")
    key = F.xxhash64(F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.char_length("word") - after + 1, after))
    return rows.withColumn("key", key)


def shards(words: DataFrame, least: int) -> DataFrame:
    """word, n, short, lo, hi, key: each word in its shards, none of which is large but those of one place."""
    part = F.array(F.char_length("word"), F.char_length("word") - 1)
    rows = words.select("word", "n", F.explode(part).alias("short")).where(F.col("short") >= least)
    rows = sharded(rows.withColumn("windows", windows(F.lit(0), F.col("short"))))
    done = []
    while True:
        large = materialise(rows.where(F.col("hi") - F.col("lo") > 1).groupBy(*KEY).count().where(F.col("count") > LARGE).drop("count"), "large")
        if large.isEmpty():
            break
        rows = materialise(rows, "shards")
        done.append(rows.join(large, list(KEY), "left_anti"))
        rows = rows.join(large, list(KEY), "left_semi").withColumn("windows", windows(F.col("lo"), F.col("hi")))
        rows = sharded(rows.select("word", "n", "short", "windows"))
    for some in done:
        rows = rows.unionByName(some)
    return rows


def letters(words: list[str], width: int) -> np.ndarray:
    """A row of letters a word, 0 beyond its end."""
    out = np.zeros((len(words), width), np.uint8)
    sizes = np.array([len(w) for w in words])
    out[np.arange(width)[None] < sizes[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return out


def near(text: np.ndarray, long: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that differ by one letter, the first of which is short: as many letters as text has columns, but one.

    text: letters of each row, dense codes, 0 for none; row i may only meet rows first[i] to last[i] - 1.
    """
    n, width = text.shape
    size = width - 1
    blocks = (n + 63) // 64
    block, bit = np.arange(n) >> 6, np.uint64(1) << (np.arange(n, dtype=np.uint64) & np.uint64(63))
    kinds = int(text.max()) + 1

    def slice_of(place: int) -> np.ndarray:
        """Bitsets of the rows with each letter at a place, a row of them a block."""
        out = np.zeros(blocks * kinds, np.uint64)
        np.bitwise_or.at(out, block * kinds + text[:, place], bit)
        return out

    longs = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(longs, block[long], bit[long])
    asked = np.flatnonzero(~long)
    from_, to = first[asked] >> 6, ((last[asked] - 1) >> 6) + 1
    count = to - from_
    query = np.repeat(asked, count)
    at = np.repeat(from_ - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(query))
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Bits of a block that belong to the query's shard.
    low = np.maximum(first[query] - at * 64, 0).astype(np.uint64)
    high = np.minimum(last[query] - at * 64, 64).astype(np.uint64)
    exact = (ones << low) & (ones >> (np.uint64(64) - high))
    replaced, longer = np.zeros_like(exact), np.zeros_like(exact)
    here = slice_of(0)
    for place in range(size):
        ahead = slice_of(place + 1)
        where = at * kinds + text[query, place]
        same, shifted = here[where], ahead[where]
        replaced = (replaced & same) | (exact & ~same)
        longer = (longer | exact) & shifted
        exact &= same
        here = ahead
    found = (replaced & ~longs[at]) | ((longer | exact) & longs[at])
    some = np.flatnonzero(found)
    row, place = np.nonzero(np.unpackbits(found[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[some[row]], at[some[row]] * 64 + place


def best_near(rows: pa.Table) -> pa.Table:
    """word, near, best_n, best: of whole shards that are sorted by KEY and word, each word's near words."""
    short = rows["short"].to_numpy()
    out = []
    edges = np.flatnonzero(np.r_[True, short[1:] != short[:-1], True])
    for a, b in zip(edges, edges[1:]):
        part, size = rows.slice(a, b - a), int(short[a])
        lo, hi, key, n = (part[c].to_numpy() for c in ("lo", "hi", "key", "n"))
        begin = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (key[1:] != key[:-1])])
        end = np.r_[begin[1:], len(key)]
        first, last = np.repeat(begin, end - begin), np.repeat(end, end - begin)
        words = part["word"].to_pylist()
        text = letters(words, size + 1)
        codes = np.zeros(256, np.uint8)
        kinds = np.unique(text)
        kinds = kinds[kinds > 0]
        codes[kinds] = np.arange(1, len(kinds) + 1)
        text, long = codes[text], text[:, size] > 0
        # Runs of whole shards with a bounded number of query rows.
        cost = np.cumsum((~long) * (1 + (last - first) // 64))
        cut = 0
        while cut < len(key):
            stop = int(np.searchsorted(cost, (cost[cut - 1] if cut else 0) + RUN, "right"))
            stop = int(last[min(stop, len(key) - 1)])
            q, t = near(text[cut:stop], long[cut:stop], first[cut:stop] - cut, last[cut:stop] - cut)
            q, t, cut = q + cut, t + cut, stop
            differs = np.argmin(text[q] == text[t], axis=1) if len(q) else q
            own = (differs >= lo[q]) & ((differs < hi[q]) | (hi[q] == size))
            q, t = q[own], t[own]
            other = long[t]  # replaced letters are found from either word
            q, t = np.r_[q, t[other]], np.r_[t, q[other]]
            order = np.lexsort((t, -n[t], q))
            q, t = q[order], t[order]
            head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
            out.append(pa.table({"word": pa.array([words[i] for i in q[head]], pa.string()), "near": pa.array(np.diff(np.r_[head, len(q)]), pa.int64()), "best_n": pa.array(n[t[head]], pa.int64()), "best": pa.array([words[i] for i in t[head]], pa.string())}))
    return pa.concat_tables(out)


@lean
def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """best_near over a task's sorted rows, some whole shards at a time."""
    held: list[pa.RecordBatch] = []
    count = 0

    def ready(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, count
        rows = pa.Table.from_batches(held)
        key, lo, hi, short = (rows[c].to_numpy() for c in ("key", "lo", "hi", "short"))
        stop = len(key)
        if not last:  # the last shard may go on
            differs = (key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]) | (short != short[-1])
            stop = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if stop:
            yield from best_near(rows.slice(0, stop)).to_batches()
        held = rows.slice(stop).combine_chunks().to_batches()
        count = len(key) - stop

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                yield from ready(False)
    if count:
        yield from ready(True)


def near_words(words: DataFrame, least: int = 7) -> DataFrame:
    """word, n_near, best_n, best of words (word, n) that have near words; best: of the largest n, then the smallest."""
    rows = shards(words, least)
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "word")
    found = rows.mapInArrow(shard_rows, "word string, near long, best_n long, best string")
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "b.best_n", "b.best")


def with_roots(words: DataFrame) -> DataFrame:
    """words (word, n, n_near, form, form_n) with root. Forms are ever more frequent, so chains are short and have an end."""
    plain = words.where("form is null").withColumn("root", F.col("word"))
    chains = materialise(words.where("form is not null").withColumn("root", F.col("form")), "chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        chains = chains.join(further, "root", "left")
        moved = materialise(chains.select("word", "n", "n_near", "form", "form_n", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "chains")
        chains = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return plain.unionByName(chains)


@tidy
def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, times: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: of each word its near word of largest n, if that is ratio times its own."""
    words = materialise(vocabulary(docs, id_col, text_col, least, times), "words")
    found = words.join(near_words(words, least), "word", "left")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    return with_roots(materialise(found, "near")).select("word", "form", "root", "n", "n_near", "form_n")
