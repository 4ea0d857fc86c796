"""Best-fit packing by patterns: non-negative least squares over the histogram of piece lengths.

Documents are tokenised, cut into pieces of at most `limit` tokens (longer ones only) and packed
into sequences of `limit`. The histogram has at most `limit` rows whatever the input, so it goes to
the driver, which enumerates patterns of one to three lengths that fill a sequence, fits their
repeat counts to the histogram by non-negative least squares, rounds them down to what is there,
and packs the residual histogram by best fit, longest first. The plan says for each length which
ranks go to which sequences and offsets; Spark ranks the pieces of a length without gathering them,
by counts per block of rows, and looks the ranks up in the plan.

Nulls: a null text is empty (its piece is the end token alone); null ids are kept. Repeated rows
are packed separately. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm.common import LOWER, SPACE, lean, materialise, remembered, text_chunks

PIECES = "id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a length that a block, a group of one task, is to hold.
ROWS_IN_BLOCK = 1024
#: Entries of an encoder's memory, some 160 bytes each, of words that came again and of words that came once, and how many new words are encoded at once.
WORDS_HELD, PARTS_HELD, AT_ONCE = 450_000, 250_000, 10_000
#: Bytes of text that are cut into words at once; each distinct word is looked up once.
CHUNK = 1 << 20
#: Kinds of bytes: white space, ASCII letters, ASCII marks but the apostrophe (contractions begin with it), and others.
BLANK, OTHER, LETTER, MARK = 0, 1, 2, 4
#: Contractions, letters, digits, marks: what such a pattern finds never has a letter beside a mark.
FINDS = re.compile(r"(?:'[a-z]+\|)*\[\\p\{L\}\]\+\|\[\\p\{N\}\]\+?\|\[\^\\s\\p\{L\}\\p\{N\}\]\+")
#: By path; other steps let go of them.
_encoders: dict[str, TextEncoder] = remembered("packing")


def cuts_words(told: dict) -> bool:
    """Whether a tokenizer's file says that it composes, lower-cases, and first of all keeps only what a pattern finds,
    which takes letters and marks apart. Its added tokens hold no white space, and not letters alone."""
    before, steps = ((told.get(kind) or {}).get(parts) or [told.get(kind) or {}] for kind, parts in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    found = (steps[0].get("pattern") or {}).get("Regex", "")
    return (
        {"type": "Lowercase"} in before
        and all(s in ({"type": "NFC"}, {"type": "Lowercase"}, blanks) for s in before)
        and (steps[0].get("type"), steps[0].get("behavior"), steps[0].get("invert")) == ("Split", "Removed", True)
        and FINDS.fullmatch(found) is not None
        and not any(t["content"].isalpha() or t["content"].split() != [t["content"]] for t in told.get("added_tokens") or [])
    )


def kinds(told: dict) -> np.ndarray:
    """The kind of each byte. Bytes of added tokens other than letters are of no kind that is cut or lower-cased."""
    out = np.full(256, OTHER, np.uint8)
    out[SPACE] = BLANK
    out[[c for c in range(0x21, 0x7F) if chr(c) != "'" and not chr(c).isalnum()]] = MARK
    out[[b for t in told.get("added_tokens") or [] for b in t["content"].encode()]] = OTHER
    out[[c for c in range(0x41, 0x7B) if chr(c).isalpha()]] = LETTER
    return out


def cut_words(data: np.ndarray, offsets: np.ndarray, kind_of: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What white space parts, cut further between a letter and a mark, and each row's first word (one more entry than rows).

    Words of letters or marks alone have their A-Z lower-cased; others may hold what composes with an upper-case letter.
    """
    kind = kind_of[data]
    # U+00C0 to U+00FF are letters but for two signs; nothing before them composes with them.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    word = kind != BLANK
    begins = word.copy()
    begins[1:] &= (kind[:-1] == BLANK) | (kind[1:] + kind[:-1] == LETTER + MARK)
    rows = offsets[offsets < len(data)]  # rows end words, too
    begins[rows] = word[rows]
    first = np.searchsorted(np.flatnonzero(begins), offsets)
    own, at = data[word], np.flatnonzero(begins[word])
    low = LOWER[own]
    if len(others := np.flatnonzero(kind[word] == OTHER)):
        kept = np.zeros(len(at), bool)
        kept[np.searchsorted(at, others, "right") - 1] = True
        kept = np.repeat(kept, np.diff(at, append=len(own)))
        low[kept] = own[kept]
    ends = np.append(at, len(own)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(low)]), first


def stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A row in parts of about CHUNK bytes that end at white space."""
    at = 0
    while len(data) - at > CHUNK:
        blank = np.flatnonzero(SPACE[data[at : at + CHUNK]])
        if not len(blank):
            blank = np.flatnonzero(SPACE[data[at:]])[:1]
            if not len(blank):
                break
        yield data[at : at + blank[-1] + 1]
        at += int(blank[-1]) + 1
    yield data[at:]


class TextEncoder:
    """Encodes whole texts. Ids are 4 bytes each."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def __call__(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each row's text."""
        for text in column:
            yield self(text.as_py() or "")


class WordEncoder(TextEncoder):
    """Encodes texts word by word, for a lower-casing tokenizer that drops white space.

    Such a tokenizer never joins what white space parts, nor a letter and a mark, so a chunk of texts is cut there, each
    distinct word is looked up once, and only words that aren't remembered are encoded. The memory is bounded: it has room for
    words that came in two chunks, and for those that came in one lately; others are encoded again.
    """

    def __init__(self, tokenizer, told: dict) -> None:
        super().__init__(tokenizer)
        self.kinds = kinds(told)
        self.held: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> bytes:
        return next(self.texts(pa.array([text], pa.string())))

    def fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        own: dict[bytes, bytes] = {}
        for at in range(0, len(words), AT_ONCE):
            some = [w.decode() for w in words[at : at + AT_ONCE]]
            # As one text: a token belongs to the word in which it starts.
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            begins = np.cumsum([0, *(len(w) + 1 for w in some)])
            cuts = (4 * np.searchsorted([lo for lo, _ in found.offsets], begins)).tolist()
            own.update((w, ids[lo:hi]) for w, lo, hi in zip(words[at : at + AT_ONCE], cuts, cuts[1:]))
        return own

    def distinct(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        found = list(map(self.held.get, words))
        rest = [w for w, ids in zip(words, found) if ids is None]
        if not rest:
            return found
        again = {w: self.once[w] for w in rest if w in self.once}
        new = self.fresh([w for w in rest if w not in again])
        for w in list(again)[: max(0, WORDS_HELD - len(self.held))]:
            self.held[w] = self.once.pop(w)
        if len(self.once) + len(new) > PARTS_HELD:
            self.once.clear()
        if len(new) <= PARTS_HELD:
            self.once.update(new)
        more = again | new
        return [more[w] if ids is None else ids for w, ids in zip(words, found)]

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
        """The ids of rows end to end, and each row's offset there."""
        words, first = cut_words(data, offsets, self.kinds)
        if not len(words):
            return b"", [0] * len(offsets)
        coded = words.dictionary_encode()
        taken = pa.array(self.distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices)
        _, ends, ids = taken.buffers()
        return (ids or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(ends, np.int32, len(taken) + 1)[first].tolist()

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        for _, _, data, offsets in text_chunks(column, CHUNK):
            if len(data) > CHUNK:  # one row
                yield b"".join([self.chunk(part, np.array([0, len(part)]))[0] for part in stretches(data)])
                continue
            ids, ends = self.chunk(data, offsets)
            for lo, hi in zip(ends, ends[1:]):
                yield ids[lo:hi]


def word_encoder(path: str) -> TextEncoder:
    """Encodes texts, word by word where the tokenizer's file allows it."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        _encoders[path] = WordEncoder(tokenizer, told) if cuts_words(told) else TextEncoder(tokenizer)
    return _encoders[path]


def piece_rows(path: str, limit: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for id_, ids in zip(batch.column("id").to_pylist(), encoder.texts(batch.column("text"))):
                ids += bytes(4)
                for k, at in enumerate(range(0, len(ids) // 4, limit)):
                    piece = ids[4 * at : 4 * (at + limit)]
                    out.append((id_, k, at, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "piece", "start", "length", "ids_crc32"])

    return lean(rows, "packing")


def patterns(limit: int, there: np.ndarray) -> list[tuple[tuple[int, int], ...]]:
    """Patterns of one, two or three lengths that fill a sequence: ((length, times), ...)."""
    found = {(limit,)}
    for a in range(1, limit // 2 + 1):
        found.add((a, limit - a))
    for a in range(1, limit // 3 + 1):
        rest = limit - a
        for b in (a, rest // 2, rest // 3, rest // 4, (a + rest // 2) // 2, (3 * a + rest // 2) // 4, (a + 3 * (rest // 2)) // 4):
            if a <= b <= rest - b:
                found.add((a, b, rest - b))
    usable = sorted(p for p in found if there[list(p)].all())
    return [tuple((x, p.count(x)) for x in dict.fromkeys(p)) for p in usable]


def repeat_counts(of: list, histogram: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares: how often to repeat each pattern, by coordinate descent."""
    x, left = np.zeros(len(of)), histogram.astype(float).tolist()
    for _ in range(sweeps):
        for i, p in enumerate(of):
            step = max(-x[i], sum(m * left[n] for n, m in p) / sum(m * m for _, m in p))
            if step:
                x[i] += step
                for n, m in p:
                    left[n] -= m * step
    return x


def best_fit(histogram: np.ndarray, limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, over counts: groups of (sequences, [(length, times), ...])."""
    done: list[tuple[int, list]] = []
    room: list[int] = []  # sorted distinct rooms of open groups
    groups: dict[int, list[tuple[int, list]]] = {}

    def put(n: int, content: list, left: int) -> None:
        if not left:
            done.append((n, content))
            return
        if left not in groups:
            groups[left] = []
            bisect.insort(room, left)
        groups[left].append((n, content))

    for length in range(limit, 0, -1):
        c = int(histogram[length])
        while c:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                space = room[at]
                n, content = groups[space].pop()
                if not groups[space]:
                    del groups[space], room[at]
            else:
                space, n, content = limit, c, []
            m = space // length
            full = min(n, c // m)
            if full:
                put(full, [*content, (length, m)], space - m * length)
                c, n = c - full * m, n - full
            if c and n and c < m:
                put(1, [*content, (length, c)], space - c * length)
                c, n = 0, n - 1
            if n and content:
                put(n, content, space)
    return done + [g for left in room for g in groups[left]]


def plan(histogram: np.ndarray, limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences. The fit may use all patterns, or only those with a long document
    where short ones are scarce; the plan with fewer sequences is taken."""
    every = patterns(limit, histogram > 0)
    best: list | None = None
    for allowed in (every, [p for p in every if max(n for n, _ in p) > limit // 2]):
        counts, left, groups = repeat_counts(allowed, histogram), histogram.copy(), []
        for i in np.argsort(-counts, kind="stable"):
            n = min([int(counts[i]), *(int(left[x]) // m for x, m in allowed[i])])
            if n > 0:
                groups.append((n, list(allowed[i])))
                for x, m in allowed[i]:
                    left[x] -= n * m
        groups += best_fit(left, limit)
        if best is None or sum(n for n, _ in groups) < sum(n for n, _ in best):
            best = groups
    return best or []


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Sorted rows (length, first rank, sequences, first sequence, first offset)."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for n, content in groups:
        offset = 0
        for length, m in content:
            rank = ranks.get(length, 0)
            rows.append((length, rank, n, sequence, offset))
            ranks[length] = rank + n * m
            offset += length * m
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = materialise(docs.mapInArrow(piece_rows(tokenizer, limit), PIECES), "pieces")
    histogram = np.zeros(limit + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `limit` rows
        histogram[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, limit)))

    # As many blocks as a length has pieces for; a row per length, so at most `limit` rows are broadcast.
    there = [(int(n), int(histogram[n]) // ROWS_IN_BLOCK + 1) for n in np.flatnonzero(histogram)]
    blocks = docs.sparkSession.createDataFrame(there, "length long, blocks int")
    pieces = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), "blocks")).drop("blocks")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "block").count()
    counts = materialise(counts.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "blocks")
    within = Window.partitionBy("length", "block").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.join(counts, ["length", "block"]).withColumn("rank", F.row_number().over(within) - 1 + F.col("before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth, turn = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            own = batch.select(["id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(row[:, 3] + turn), pa.array(row[:, 4] + nth * length)], [*own.schema.names, "sequence_id", "offset"])

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, PIECES + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
