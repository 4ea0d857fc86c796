"""N-gram Jaccard self-join: size-banded tiles with hashed bitmap signatures.

A document's set holds its distinct k-word shingles. Two linked sets share so many that, in any order
of all shingles, the first `n_prefix` of either have one in common. The order puts first what no other
set holds, so that prefixes share little: the sets that hold a shingle are counted for a part of all
shingles, chosen by hash (`SHARE` times what the threshold leaves over, at most all). Counted shingles
of one set come first, then those not counted, then shared ones, then those of many sets; ties by hash.
The counts decide the order alone, never what is compared.

Sizes fall in bands as wide as the threshold allows, so that linked sets are in one band or in two
neighbours. Sets of a band, and those of the band below, that have a shingle in their prefixes in
common share a tile. Two rounds meet them. First each member is compared with its tile's hub, the
smallest id of the band: linear in the tile, however large. Then only tiles that still hold several
components are compared, in blocks of bounded size. A pair's sizes and the places of the shingle in
both prefixes bound the overlap from above; then 2048-bit signatures do: a bit set in one only belongs
to a shingle that the other lacks. What the bounds leave is settled by intersecting sorted arrays.

Nulls: a document with a null or blank text has an empty set and links with nothing. Rows with a
null id are returned with a null class. Rows that repeat an id are one document, linked by any of its
texts. Extra columns are ignored. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.llm.common import HELD, LOWER, Counter, bit_table, components, gram_hashes, has_bit, id_table, lean, materialise, may_hold, mix, split_words, table_bits, text_chunks, tidy, word_hashes

SIGNATURE_BITS = 2048
BLOCK = 1024
#: Counted shingles, as a multiple of what the threshold leaves over; sets that hold a shingle of many.
SHARE, MANY = 2.5, 64
SETS = "id long, n long, d1 long, d2 long, sig binary"
KEYED = "key long, id long, n long, pos long, own boolean"


def bands(percent: int, upto: int = 1 << 40) -> np.ndarray:
    """First size of each band: a size and the largest that can be linked with it are at most one band apart."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent + 1))
    return np.array(out, np.int64)


def n_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set's prefix: two linked sets share as many as are left after one's prefix, and one more."""
    return n - (percent * n + 99) // 100 + 1


def counted(of: np.ndarray, percent: int) -> np.ndarray:
    """Whether a shingle is of those that are counted."""
    return (of & np.uint64(0xFFFF)) < np.uint64(min(65536, int(SHARE * (100 - percent) * 655.36)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; fewer words than k make one shingle."""
    starts, ends, first = split_words(data, offsets)
    words = word_hashes(LOWER[data] if lower else data, starts, ends)
    grams = gram_hashes(words, k)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= k:
            some = np.sort(grams[lo : hi - k + 1])
            yield some[np.r_[True, some[1:] != some[:-1]]]
        else:
            yield gram_hashes(words[lo:hi], int(hi - lo)) if hi > lo else np.empty(0, np.uint64)


def signature(of: np.ndarray) -> bytes:
    out = np.zeros(SIGNATURE_BITS, np.uint8)
    out[(of >> np.uint64(32) & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def set_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                n, d1, d2, sigs = [], [], [], []
                with np.errstate(over="ignore"):
                    for of in shingle_sets(data, offsets, k):
                        n.append(len(of))
                        a = mix(of)
                        d1.append(a.sum(dtype=np.uint64))
                        d2.append(mix(a ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                        sigs.append(signature(of) if len(of) else None)
                yield pa.record_batch(
                    {
                        "id": batch.column("id").slice(lo, hi - lo),
                        "n": pa.array(n, pa.int64()),
                        "d1": pa.array(np.array(d1, np.uint64).view(np.int64)),
                        "d2": pa.array(np.array(d2, np.uint64).view(np.int64)),
                        "sig": pa.array(sigs, pa.binary()),
                    }
                )

    return lean(rows)


def _of(batch: pa.RecordBatch, reps) -> pa.RecordBatch:
    """Rows that stand for themselves, and few of the copies; any may be kept."""
    return batch.filter(pa.array(has_bit(reps.value, batch.column("h").to_numpy().view(np.uint64))))


def count_rows(k: int, percent: int, reps):
    """How many sets hold each counted shingle; sums of a task's rows, so that a frequent one is few rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed() -> pa.RecordBatch:
            keys, n = counter.merge()
            return pa.record_batch({"key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        counter = Counter()
        for batch in batches:
            for _, _, data, offsets in text_chunks(_of(batch, reps).column("text")):
                sets = np.concatenate([*shingle_sets(data, offsets, k)])
                counter.add(sets[counted(sets, percent)])
                if counter.size > HELD:
                    yield passed()
                    counter = Counter()
        yield passed()

    return lean(rows)


def prefix_rows(k: int, percent: int, reps, shared, common):
    """A row for each shingle of a set's prefix that another may hold, in its own band and in the next one."""
    first = bands(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _of(batch, reps)
            ids = batch.column("id").to_numpy()
            for lo, _, data, offsets in text_chunks(batch.column("text")):
                sets = [*shingle_sets(data, offsets, k)]
                n = np.array([*map(len, sets)], np.int64)
                flat, row = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
                kind = np.where(counted(flat, percent), np.where(has_bit(shared.value, flat), np.where(has_bit(common.value, flat), 3, 2), 0), 1)
                order = np.argsort(row * 4 + kind, kind="stable")  # hashes are in order already
                flat, kind = flat[order], kind[order]
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                keep = (pos < n_prefix(n, percent)[row]) & (kind > 0)
                flat, row, pos = flat[keep], row[keep], pos[keep]
                band = np.searchsorted(first, n, "right")[row].astype(np.uint64)
                for own in (True, False):
                    with np.errstate(over="ignore"):
                        key = mix(flat ^ (band + np.uint64(not own)) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.record_batch({"key": pa.array(key.view(np.int64)), "id": pa.array(ids[lo:][row]), "n": pa.array(n[row]), "pos": pa.array(pos), "own": pa.array(np.full(len(row), own))})

    return lean(rows)


def _linked(na, nb, overlap, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def _bounds(sig_a: np.ndarray, sig_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most shingles that two sets can share, from their signatures."""
    only_a = np.bitwise_count(sig_a & ~sig_b).sum(1, dtype=np.int64)
    only_b = np.bitwise_count(sig_b & ~sig_a).sum(1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def _matrix(column: pa.Array) -> np.ndarray:
    size = SIGNATURE_BITS // 8
    flat = np.frombuffer(column.buffers()[2], np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return flat[start : start + len(column) * size].reshape(-1, size).view(np.uint64)


def may_link(na: Column, nb: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of these sizes whose first common shingle is at these places can be linked."""
    most = F.least(na - i, nb - j)
    return 100 * most >= percent * (na + nb - most)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), a written table, those that their signatures allow to be linked."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                keep = _linked(na, nb, _bounds(_matrix(batch.column("sa")), _matrix(batch.column("sb")), na, nb), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    sigs = materialise(sets.where("n > 0").select("id", "n", "sig").where(may_hold(id_table(_ends(pairs), "id"), "id")), "paired")
    near = pairs.join(sigs.toDF("a", "na", "sa"), "a").join(sigs.toDF("b", "nb", "sb"), "b")
    return near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(rows), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets are linked."""

    def rows(batches):
        for batch in batches:
            n = batch.num_rows
            keep = np.zeros(n, bool)
            for lo in range(0, n, 128):
                part = batch.slice(lo, 128)
                both = [[s for _, _, d, o in text_chunks(part.column(c)) for s in shingle_sets(d, o, k)] for c in ("ta", "tb")]
                for i, (x, y) in enumerate(zip(*both)):
                    keep[lo + i] = len(x) and _linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    near = materialise(pairs, "near")
    docs = materialise(docs.where(may_hold(id_table(_ends(near), "id"), "id")), "texts")
    return near.join(docs.toDF("a", "ta"), "a").join(docs.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(lean(rows), "a long, b long").distinct()


def tile_pairs(percent: int):
    """Pairs of one tile block whose labels differ and whose signatures allow a link.

    Rows come sorted by tile; row i meets row i + step of its tile, for all rows of a batch at once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            tile = table["tile"].to_numpy()
            cut = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
            held = table.slice(cut).combine_chunks()
            yield from compared(table.slice(0, cut))
        if held is not None:
            yield from compared(held)

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        tile, id_, c, n, pos, own, side = (table[x].to_numpy() for x in ("tile", "id", "c", "n", "pos", "own", "side"))
        sig = _matrix(table["sig"].chunk(0))
        step = 1
        while step < len(tile):
            i = np.flatnonzero(tile[step:] == tile[:-step])
            if not len(i):
                return
            j = i + step
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])
            i = i[(c[i] != c[j]) & (own[i] | own[j]) & ((side[i] < 0) | (side[i] != side[j])) & _linked(n[i], n[j], most, percent)]
            for at in range(0, len(i), 20_000):
                x = i[at : at + 20_000]
                y = x + step
                keep = _linked(n[x], n[y], _bounds(sig[x], sig[y], n[x], n[y]), percent)
                a, b = id_[x[keep]], id_[y[keep]]
                if len(a):
                    yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
            step += 1

    return lean(rows)


@tidy
def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = materialise(docs.mapInArrow(set_rows(k), SETS), "sets")
    known = sets.where("n > 0 and id is not null")
    same = ["n", "d1", "d2"]
    classes = materialise(known.groupBy(*same).agg(F.min("id").alias("rep")), "classes")

    # Copies stand behind their representative.
    reps = id_table(classes, "rep")
    texts = docs.where("id is not null")
    hashed = texts.select("id", "text", F.xxhash64("id").alias("h"))
    counts = hashed.mapInArrow(count_rows(k, percent, reps), "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where("n > 1"), "counts")
    shared, common = (docs.sparkSession.sparkContext.broadcast(bit_table(of, "key", table_bits(of.count()))) for of in (counts, counts.where(F.col("n") > MANY)))

    keyed = materialise(hashed.mapInArrow(prefix_rows(k, percent, reps, shared, common), KEYED), "keyed")
    hub = F.min(F.when(F.col("own"), F.col("id")))
    tiles = materialise(keyed.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("members")).where("members > 1 and hub is not null"), "tiles")
    keyed = materialise(keyed.join(tiles, "key"), "tiled")
    hubs = keyed.where("id = hub and own").select("key", F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"))
    met = keyed.where("id <> hub").join(hubs, "key").where(may_link(F.col("n"), F.col("hub_n"), F.col("pos"), F.col("hub_pos"), percent))
    met = materialise(met.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "met")

    # Rows that repeat an id with other texts are in several classes, which it links.
    again = materialise(known.select("id", *same).distinct().groupBy("id").count().where("count > 1").select("id"), "again")
    again = known.join(again, "id", "left_semi").join(classes, same).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    first = verified(bounded(met, sets, percent), texts, k, percent).unionByName(again)
    first = materialise(first, "links")
    found = components(first)

    labelled = keyed.where("members > 2").join(found, "id", "left").select("key", "id", "n", "pos", "own", "hub", F.coalesce("component", "id").alias("c"))
    # Pairs with the hub are settled, so what is open are several labels among the others.
    others = materialise(labelled.where("id <> hub"), "labelled")
    open_ = others.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.max("own").alias("some")).where("lo < hi and some")
    open_ = materialise(open_.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open")
    dealt = (
        others.drop("hub")
        .join(open_, "key")
        .join(sets.where("n > 0").select("id", "n", "sig").dropDuplicates(["id", "n"]), ["id", "n"])
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("tile", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        # In a tile of two blocks only rows of different blocks meet; a block meets itself in its own tile.
        .select("tile", "id", "c", "n", "pos", "own", "sig", F.when((F.col("blocks") == 1) | (F.col("block") == F.col("other")), -1).otherwise(F.col("block")).alias("side"))
    )
    pairs = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(tile_pairs(percent), "a long, b long").distinct()
    found = components(first.unionByName(verified(pairs, texts, k, percent)))

    classes = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sets.select("id", *same).join(classes, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
