"""Language-model scoring by partial matching over bytes.

The model is a trie of byte contexts up to `order` long. Spark counts every (order + 1)-gram of the
training texts and sums them to all shorter orders: the nodes. Every node is used, whatever the
corpus. A byte's probability depends on its gram alone, so each distinct gram of all texts is priced
once: nodes and grams meet in shards by the last bytes of their contexts (`OWN`), with the nodes of
shorter contexts, of which there are at most 256**3, sent to every shard. Prices of the most frequent
grams, at most `max_nodes`, are broadcast to score texts; the other grams of each document are joined
with the prices. So the bound on what is broadcast changes no score. A byte is coded in the longest known context; where it isn't there, an escape
(method D: half a count of each distinct symbol) leads to the next shorter one, in which the
symbols already ruled out are excluded. Contexts are nested, so what is excluded depends on the
context escaped from alone, and all escapes are summed once per node, before scoring.
`adaptive_code_length` starts each document with an empty trie instead.

Texts have A-Z in lower case. A text is its bytes and an end symbol; 0xFF, which UTF-8 never has,
stands for the end and for what is before the start. A null text is empty: only its end is coded.

The base is a unigram model over words. Counts of the most frequent words (a fixed number) are
broadcast; the other words of each document are joined with the counts table. Words are counted by
64-bit hashes. Rows with a null id belong to no held-out fold and are trained on. Repeated rows are
separate documents. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.common import HELD, LOWER, Counter, fold, lean, materialise, split_words, text_chunks, word_hashes

END = 0xFF
WORDS, GRAMS, ENDS, UNTRAINED = 0, 1, 2, 3
#: Bytes before the last that decide a gram's shard, and the grams to price that a shard is to have.
OWN, SHARD = 3, 200_000


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's (order + 1)-grams, end included, as numbers; and where each row starts among them."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(len(data) + rows * (order + 1), END, np.uint8)
    row = np.repeat(np.arange(rows), size)
    padded[np.arange(len(data)) + row * (order + 1) + order] = data
    n = len(padded) - order
    keys = padded[:n].astype(np.uint64)
    for i in range(1, order + 1):
        keys <<= np.uint64(8)
        keys |= padded[i : n + i]
    keep = np.ones(n, bool)
    begin = offsets[:-1] + np.arange(rows) * (order + 1)
    for i in range(1, order + 1):  # grams that end in the padding before a later row
        at = begin[1:] - i
        keep[at] = False
    return keys[keep], offsets[:-1] + np.arange(rows)


def count_rows(order: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(kind: int) -> pa.RecordBatch:
            keys, n = counters[kind].merge()
            counters[kind] = Counter()
            return pa.record_batch({"kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        counters, ends = {WORDS: Counter(), GRAMS: Counter(), UNTRAINED: Counter()}, 0
        for batch in batches:
            for learn in (True, False):
                texts = batch.column("text").filter(pc.equal(batch.column("held_out"), not learn))
                for lo, hi, data, offsets in text_chunks(texts):
                    data = LOWER[data]
                    counters[GRAMS if learn else UNTRAINED].add(grams_of(data, offsets, order)[0])
                    if learn:
                        starts, stops, _ = split_words(data, offsets)
                        counters[WORDS].add(word_hashes(data, starts, stops))
                        ends += hi - lo
                    for kind in counters:
                        if counters[kind].size > HELD:
                            yield passed(kind)
        for kind in counters:
            yield passed(kind)
        yield pa.record_batch({"kind": pa.array([ENDS], pa.int32()), "key": pa.array([0], pa.int64()), "n": pa.array([ends], pa.int64())})

    return lean(rows)


class Lookup:
    """An open-addressing table from numbers under 2**63 to 0, 1, 2... in the order given."""

    NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.NONE, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == self.NONE
            self.keys[slot[free]] = keys[left[free]]
            self.at[slot[free]] = left[free]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != self.NONE))
        while len(left):
            slot_left = (slot[left] + 1) & self.mask
            slot[left] = slot_left
            there = self.keys[slot_left]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot_left[hit]]
            left = left[~hit & (there != self.NONE)]
        return out


class Trie:
    """The pretrained model, or a shard of it: logarithms by node, ready for scoring arrays of grams."""

    def __init__(self, order: int, depth: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.order = order
        self.grams, self.hit, self.contexts, self.node = [], [], [], []
        below = None
        for k in range(order + 1):
            of = depth == k
            sort = np.argsort(gram[of])
            keys, counts = gram[of][sort], n[of][sort].astype(np.float64)
            context = keys >> np.uint64(8)
            at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.empty(0, np.int64)
            total = np.add.reduceat(counts, at) if len(at) else counts
            distinct = np.diff(np.r_[at, len(keys)]).astype(np.float64)
            own = np.repeat(np.arange(len(at)), distinct.astype(np.int64))
            escape = np.log10(distinct / (2 * total)) if len(at) else total
            cum, norm = np.zeros(len(at)), np.zeros(len(at))
            if k and len(at):
                lower_keys, lower_counts, lower_contexts, lower_total, lower_distinct, lower_cum = below
                parent = np.searchsorted(lower_contexts, context[at] & np.uint64((1 << 8 * (k - 1)) - 1))
                short = keys & np.uint64((1 << 8 * k) - 1)
                excluded = np.bincount(own, lower_counts[np.searchsorted(lower_keys, short)], len(at))
                new = lower_distinct[parent] - distinct
                norm = np.log10(np.maximum(2 * (lower_total[parent] - excluded), 1))
                cum = np.where(new > 0, np.log10(np.maximum(new, 1)) - norm, 0.0) + lower_cum[parent]
            self.grams.append(Lookup(keys))
            alone = np.log10(2 * counts - 1)
            self.hit.append(np.stack([alone, alone - np.log10(2 * total)[own]]) if len(keys) else np.zeros((2, 0)))
            self.contexts.append(Lookup(context[at]))
            self.node.append(np.stack([escape, cum, norm]))
            below = keys, counts, context[at], total, distinct, cum
            if not k:
                unseen = 256 - (distinct[0] if len(at) else 0)
                self.uniform = -math.log10(max(unseen, 1))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        found = self.grams[self.order].find(keys)
        out = self.hit[self.order][1][found] if self.hit[self.order].shape[1] else np.zeros(len(keys))
        left = np.flatnonzero(found < 0)
        escape, cum, last_cum, last_norm = (np.zeros(len(left)) for _ in range(4))
        begun = np.zeros(len(left), bool)
        for k in range(self.order, -1, -1):
            if not len(left):
                break
            short = keys[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            if k < self.order:
                at = self.grams[k].find(short)
                hit = at >= 0
                if hit.any():
                    alone, full = self.hit[k][0][at[hit]], self.hit[k][1][at[hit]]
                    out[left[hit]] = np.where(begun[hit], escape[hit] + cum[hit] - last_cum[hit] + alone - last_norm[hit], full)
                    left, short, escape, cum, last_cum, last_norm, begun = (x[~hit] for x in (left, short, escape, cum, last_cum, last_norm, begun))
            at = self.contexts[k].find(short >> np.uint64(8))
            there = at >= 0
            node = self.node[k][:, at[there]]
            first = there & ~begun
            now = first[there]
            escape[first], cum[first] = node[0][now], node[1][now]
            last_cum[there], last_norm[there] = node[1], node[2]
            begun |= there
        out[left] = escape + cum + self.uniform
        return out


def train(docs: DataFrame, order: int = 5) -> tuple[DataFrame, DataFrame]:
    """Prices (gram, price, n) of all grams of the column text, by the rows that are not held_out; and
    the counts of those rows' words (kind 0: key, n) and of those rows (kind 2)."""
    counts = materialise(docs.select("text", "held_out").mapInArrow(count_rows(order), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    grams = counts.where(F.col("kind") == GRAMS).select("n", F.posexplode(F.array(*(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1) for k in range(order + 1)))).alias("depth", "gram"))
    nodes = materialise(grams.groupBy("depth", "gram").agg(F.sum("n").alias("n")), "nodes")
    asked = counts.where(F.col("kind").isin(GRAMS, UNTRAINED)).groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")).select(F.lit(-1).alias("depth"), "gram", "n")
    few = nodes.where(F.col("depth") < OWN).toArrow()
    short = docs.sparkSession.sparkContext.broadcast([few[c].to_numpy() for c in ("depth", "gram", "n")])

    def priced(table: pa.Table) -> pa.Table:
        depth, gram, n = (table[c].to_numpy() for c in ("depth", "gram", "n"))
        ask = depth < 0
        every = [np.concatenate([x, y[~ask]]) for x, y in zip(short.value, (depth, gram, n))]
        trie = Trie(order, every[0], every[1].view(np.uint64), every[2])
        return pa.table({"gram": gram[ask], "price": trie.score(gram[ask].view(np.uint64)), "n": n[ask]})

    distinct = counts.where(F.col("kind").isin(GRAMS, UNTRAINED)).count()
    own = F.shiftrightunsigned("gram", 8).bitwiseAND((1 << 8 * OWN) - 1)
    both = nodes.where(F.col("depth") >= OWN).unionByName(asked).withColumn("shard", F.pmod(F.xxhash64(own), F.lit(1 + distinct // SHARD)))
    prices = both.groupBy("shard").applyInArrow(priced, "gram long, price double, n long")
    return materialise(prices, "prices"), counts.where(F.col("kind").isin(WORDS, ENDS))


def most_frequent(prices: DataFrame, most: int) -> tuple[Lookup, np.ndarray]:
    """At most `most` grams and their prices: those from the smallest count, a power of two, that so few have."""
    sizes = prices.agg(*(F.count_if(F.col("n") >= (1 << i)).alias(f"s{i}") for i in range(62))).first()
    least = next((1 << i for i in range(62) if sizes[i] <= most), 1 << 62)
    kept = prices.where(F.col("n") >= least).select("gram", "price").toArrow()
    return Lookup(kept["gram"].to_numpy().view(np.uint64)), kept["price"].to_numpy()


SCORED = "id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>, rest_grams array<struct<gram:long,times:long>>"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 5, max_nodes: int = 1 << 21, common: int = 1 << 20) -> DataFrame:
    """Scores every row after training on rows outside the held-out fold."""
    spark = docs.sparkSession
    held = F.coalesce(fold(F.col(id_col), 5) == 1, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    prices, counts = train(docs, order)
    words = counts.where(F.col("kind") == WORDS)
    ends = counts.where(F.col("kind") == ENDS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    norm = math.log10(total + 0.5 * (distinct + 1))
    most = words.orderBy(F.desc("n"), "key").limit(common).select("key", "n").toArrow()
    most_keys, most_n = most["key"].to_numpy().view(np.uint64), most["n"].to_numpy()
    shared = spark.sparkContext.broadcast((*most_frequent(prices, max_nodes), Lookup(most_keys), most_n, ends, norm))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, price, table, n, ends, norm = shared.value
        price = np.r_[price, 0.0]
        logs = np.r_[np.log10(n + 0.5) - norm, 0.0]
        end = math.log10(ends + 0.5) - norm
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                data = LOWER[data]
                starts, stops, first = split_words(data, offsets)
                hashes = word_hashes(data, starts, stops)
                at = table.find(hashes)
                sums = np.r_[0.0, np.cumsum(logs[at])]
                known = np.r_[0, np.cumsum(at >= 0)]
                rest = np.r_[0, np.cumsum(at < 0)][first]
                keys, begin = grams_of(data, offsets, order)
                place = grams.find(keys)
                lost = np.flatnonzero(place < 0)
                of = np.searchsorted(begin, lost, "right") - 1
                sort = np.lexsort((keys[lost], of))
                lost, of = keys[lost][sort], of[sort]
                new = np.flatnonzero(np.r_[True, (lost[1:] != lost[:-1]) | (of[1:] != of[:-1])]) if len(lost) else np.empty(0, np.int64)
                times = pa.StructArray.from_arrays([pa.array(lost[new].view(np.int64)), pa.array(np.diff(np.r_[new, len(lost)]))], ["gram", "times"])
                yield pa.record_batch(
                    {
                        "id": batch.column("id").slice(lo, hi - lo),
                        "held_out": batch.column("held_out").slice(lo, hi - lo),
                        "n_tokens": pa.array(np.diff(first) + 1),
                        "known": pa.array(np.diff(known[first]) + (ends > 0)),
                        "base": pa.array(np.diff(sums[first]) + end),
                        "score": pa.array(np.add.reduceat(price[place], begin)),
                        "rest": pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(hashes[at < 0].view(np.int64))),
                        "rest_grams": pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(hi - lo + 1)).astype(np.int32)), times),
                    }
                )

    rows = materialise(docs.mapInArrow(scored, SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = rows.select("row", F.explode("rest").alias("key")).groupBy("row", "key").count()
    rest = rest.join(words.select("key", "n"), "key", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("count")).otherwise(0)).alias("more_known"),
        F.sum(F.col("count") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(norm))).alias("more_base"),
    )
    grams = rows.select("row", F.inline("rest_grams")).join(prices.select("gram", "price"), "gram")
    grams = grams.groupBy("row").agg(F.sum(F.col("times") * F.col("price")).alias("more_score"))
    return rows.drop("rest", "rest_grams").join(rest, "row", "left").join(grams, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


class AdaptiveTrie:
    """A trie that learns each symbol after coding it."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}

    def code(self, context: bytes, symbol: int) -> float:
        """log10 of the symbol's probability; counts it in all its contexts."""
        log, excluded = 0.0, set()
        contexts = [context[len(context) - k :] for k in range(self.order, -1, -1)]
        for c in contexts:
            seen = {s: n for s, n in self.counts.get(c, {}).items() if s not in excluded}
            if seen:
                room = 2 * sum(seen.values())
                if symbol in seen:
                    log += math.log10((2 * seen[symbol] - 1) / room)
                    break
                log += math.log10(len(seen) / room)
                excluded |= seen.keys()
        else:
            log -= math.log10(256 - len(excluded))
        for c in contexts:
            here = self.counts.setdefault(c, {})
            here[symbol] = here.get(symbol, 0) + 1
        return log


def adaptive_code_length(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """id and score: each document's log10 probability when it is learnt from its own start alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                trie, padded = AdaptiveTrie(order), bytes([END] * order) + LOWER[np.frombuffer((text.as_py() or "").encode(), np.uint8)].tobytes() + bytes([END])
                scores.append(sum(trie.code(padded[i - order : i], padded[i]) for i in range(order, len(padded))))
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(scores, pa.float64())})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, "id long, score double").withColumnRenamed("id", id_col)
