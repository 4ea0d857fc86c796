import hashlib
import math
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quizloom.llm import additive, common, license, mixing, multi_index, ngram_join, packing, ppm, quality, queries, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, kept string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and then it left the house for good today", "en", "src0", 1, 5, "x"),
    (2, "the CAT sat on the mat and then it left the house for good today again", "en", "src0", 1, 5, None),
    (3, None, None, None, None, None, None),
    (4, "", "en", "src1", 0, 1, "x"),
    (5, " \n\t ", "de", "src1", 3, 1, "x"),
    (6, LONG, "de", "src2", 1, 1, "x"),
    (7, LONG, "de", "src2", 1, 1, "x"),
    (8, "one two", "en", "src2", 1, 1, "x"),
    (8, "one two", "en", "src2", 1, 1, "x"),
    (None, "one two", "en", "src2", 1, 1, "x"),
]
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_hashes_do_not_depend_on_windows(monkeypatch):
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*rng.integers(1, 40, 300), 500_000, 131_072, 131_073, 7]]
    data = np.frombuffer(b" ".join(parts), np.uint8)
    starts, ends, first = common.split_words(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == parts and first.tolist() == [0, len(parts)]
    plain = []
    for w in parts:
        total = 0
        for b in reversed(w):
            total = (total * int(common._BASE) + b + 1) % (1 << 64)
        plain.append((total + len(w) * int(common._STEP)) % (1 << 64))
    assert (common.word_hashes(data, starts, ends) == common.mix(np.array(plain, np.uint64))).all()


def test_rows_end_words():
    texts = ["ab", "", "c", " d", "e ", None, "fg"]
    (chunk,) = common.text_chunks(pa.array(texts))
    starts, ends, first = common.split_words(*chunk[2:])
    assert [bytes(chunk[2][a:b]) for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", b"e", b"fg"] and first.tolist() == [0, 1, 1, 2, 3, 4, 4, 5]


def test_very_long_text(spark):
    long = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(600_000))  # some 4 MB
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "short one")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()}
    assert gone == {1: (600_000, 0), 2: (600_001, 600_000), 3: (1, 0), 4: (2, 0)}


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(name, spark, sf_dir, same):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def test_language_model(spark, sf_dir, odd, empty):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in queries.op1_language_model(spark, sf_dir).collect()}
    lowered = {r["doc_id"]: (r["text"] or "").encode().translate(LOWER) for r in docs}
    learnt = [d for i, d in lowered.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for d in learnt for w in [*d.split(), None])
    n, v, order = sum(counts.values()), len(counts), 5
    seen: dict = {}
    for d in learnt:
        padded = b"\xff" * order + d + b"\xff"
        for i in range(order, len(padded)):
            for k in range(order + 1):
                here = seen.setdefault(padded[i - k : i], {})
                here[padded[i]] = here.get(padded[i], 0) + 1

    def code(context, symbol):
        log, out = 0.0, set()
        for k in range(order, -1, -1):
            left = {s: c for s, c in seen.get(context[order - k :], {}).items() if s not in out}
            if left:
                if symbol in left:
                    return log + math.log10((2 * left[symbol] - 1) / (2 * sum(left.values())))
                log += math.log10(len(left) / (2 * sum(left.values())))
                out |= left.keys()
        return log - math.log10(256 - len(out))

    for i, d in list(lowered.items())[:25]:
        r, tokens, padded = rows[i], [*d.split(), None], b"\xff" * order + d + b"\xff"
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r["score"] == pytest.approx(sum(code(padded[j - order : j], padded[j]) for j in range(order, len(padded))))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
    few = ppm.score_documents(odd, common=2, max_nodes=50).collect()
    assert len(few) == len(ROWS) and all(r["score"] < 0 for r in few)
    full = {r["doc_id"]: r["base_score"] for r in ppm.score_documents(odd).collect()}
    assert all(r["base_score"] == pytest.approx(full[r["doc_id"]]) for r in few)
    assert ppm.score_documents(empty).count() == 0
    adaptive = {r["doc_id"]: r["score"] for r in ppm.adaptive_code_length(odd.where("doc_id < 6")).collect()}
    assert adaptive[3] == adaptive[4] == pytest.approx(-math.log10(256)) and adaptive[1] < adaptive[5]


def test_language_model_uses_every_node(spark, sf_dir, monkeypatch):
    docs = queries.table(spark, sf_dir, "documents")
    full = {r["doc_id"]: r["score"] for r in ppm.score_documents(docs).collect()}  # held against brute force above
    monkeypatch.setattr(ppm, "SHARD", 5000)
    few = {r["doc_id"]: r["score"] for r in ppm.score_documents(docs, max_nodes=500).collect()}
    assert few.keys() == full.keys() and all(few[i] == pytest.approx(full[i]) for i in full)


def test_archives(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "<p>a</p>\r\n\r\nWARC/1.1\r\n", 0), (2, None, "<p>a</p>\r\n\r\nWARC/1.1\r\n", 0), (3, "a\r\nb", None, 0), (4, "u", "", 0), (None, "u", "x", 0), (5, "u", "é" * 9, 0), (5, "u", "é" * 9, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 22), (2, "response", None, 22), (3, "revisit", 4, 0), (4, "response", None, 0), (0, "response", None, 1), (5, "response", None, 18), (5, "response", None, 18)], key=str)
    with monkeypatch.context() as small_files:
        small_files.setattr(warc, "SMALL", 4)
        small_files.setattr(warc, "FILE_BYTES", 64)
        warc.write(pages, str(tmp_path / "classes"), date="2024-01-01T00:00:00Z")
        again = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, str(tmp_path / "classes")).collect()), key=str)
        assert again == got and {p.name for p in (tmp_path / "classes").iterdir()} >= {"size=0", "size=1", "size=2"}
    warc.write(pages, str(tmp_path / "w"), min_bytes=10)
    small = {r["page_id"]: r["record_type"] for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert small[3] == small[4] == "response" and small[1] == "revisit"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_with_many_copies_and_a_long_page(spark):
    rows = [(i, "u", f"page {i % 7}" if i % 3 else "the same", i % 7) for i in range(300)] + [(None, "u", "the same", 0), (900, "u", "x" * 9_000_000, 0), (901, "u", "x" * 9_000_000, 0)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long")).collect()}
    last = {}
    for i, _, html, _ in rows:
        last[html] = max(last.get(html, -1), -1 if i is None else i)
    assert got == {i: ("response", None) if last[html] == i else ("revisit", last[html]) for i, _, html, _ in rows}


def test_mixing(spark, odd, empty):
    out = mixing.mixed(odd, F.lit(None), 0.5, 2, {})
    total = odd.select(F.sum(mixing.tokens(F.col("text")))).first()[0]
    taken = out.select(F.sum(F.col("passes") * F.col("n_tokens") + F.col("prefix_tokens"))).first()[0]
    assert taken == int(total * 0.5) and mixing.mixed(empty, F.lit("d"), 0.5, 2, {}).count() == 0
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "y", "s", 100), ("b", "x", "s", 1000)], "domain string, language string, source string, total long")
    got = {(r["domain"], r["language"]): r["allotment"] for r in mixing.leaf_budgets(leaves, 100, 1, {"domain": {"a": 3}}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 65, ("b", "x"): 25}  # the sibling takes what a/x lacks
    got = {(r["domain"], r["language"]): r["allotment"] for r in mixing.leaf_budgets(leaves, 400, 1, {"domain": {"a": 3}}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}  # no sibling is left
    assert sum(r["allotment"] for r in mixing.leaf_budgets(leaves, 10_000, 1, {"source": {"s": 7}}).collect()) == 1110


def plain_pieces(rows, limit=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for id_, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(id_, k, at, len(ids[at : at + limit]), zlib.crc32(ids[at : at + limit].tobytes())) for k, at in enumerate(range(0, len(ids), limit))]
    return sorted(out, key=str)


def held_together(rows, limit=2048):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_packing(spark, sf_dir, odd, empty):
    path = queries.tokenizer()
    for docs in (queries.table(spark, sf_dir, "documents"), odd, spark.createDataFrame([(1, "It's <|endoftext|>, NAÏVE... x'll 12 é́ A.B c!?")], "doc_id long, text string")):
        rows = packing.pack(docs, path).collect()
        assert sorted((tuple(r)[:5] for r in rows), key=str) == plain_pieces([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        tokens, halves = sum(r["length"] for r in rows), sum(r["length"] > 1024 for r in rows)
        assert held_together(rows) <= max(math.ceil(tokens / 2048), halves) + 1
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_piece(seed):
    rng, limit = np.random.default_rng(seed), 64
    histogram = np.r_[0, rng.integers(0, 1 + 10 ** (seed % 4), limit)]
    groups = packing.plan(histogram, limit)
    placed = np.zeros(limit + 1, np.int64)
    for n, content in groups:
        assert n > 0 and sum(x * m for x, m in content) <= limit
        for x, m in content:
            placed[x] += n * m
    assert (placed == histogram).all()
    tokens = int((histogram * np.arange(limit + 1)).sum())
    assert sum(n for n, _ in groups) <= max(-(-tokens // limit), histogram[limit // 2 + 1 :].sum()) * 1.05 + 2


def area(good, bad):
    """Share of pairs of a good and a bad score that are in order."""
    order = np.sort(bad)
    return ((np.searchsorted(order, good, "left") + np.searchsorted(order, good, "right")) / 2).mean() / len(bad)


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    out = queries.op5_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert area(good, bad) >= 0.99 and out.score.between(0, 1).all()
    assert (good >= 0.7).mean() >= 0.99 and (bad >= 0.7).mean() <= 0.05
    labels = queries.table(spark, sf, "labels")
    for none in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int")), labels.where("quality = 1")):
        model = quality.fit(odd, none)
        assert quality.with_score(odd, model).where("score is null").isEmpty()
    assert quality.with_score(empty, model).count() == 0


@pytest.mark.parametrize("odd_rows", [False, True])
def test_quality_equals_plain_compression(spark, sf_dir, odd, odd_rows):
    docs, labels = (queries.table(spark, sf_dir, t) for t in ("documents", "labels"))
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "quality")
    if odd_rows:  # empty, null, long, repeated and tied rows, unlabelled and twice labelled ones
        more = [(9000, "", 1), (9001, None, 0), (9002, LONG, 0), (9003, "tie tie", 1), (9004, "tie tie", 0), (9005, "twice", 1), (9005, "twice", 0), (9006, "no label", None), (None, "no id", 1)]
        docs = docs.unionByName(spark.createDataFrame([m[:2] for m in more] + [(9003, "tie")], docs.schema))
        labels = labels.unionByName(spark.createDataFrame([(m[0], m[2]) for m in more], "doc_id long, quality int"))
    texts, marks = {}, {}
    for i, t in docs.collect():
        if i is not None and 0 < len((t or "").encode()) <= 1 << 14:
            texts[i] = min(texts.get(i, t), t)
    for i, q in labels.collect():
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            marks.setdefault(i, []).append(q)
    marks = {i: int(np.mean(q) >= 0.5) for i, q in marks.items()}
    order = [r["doc_id"] for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r["doc_id"] in marks and r["doc_id"] in texts]
    by = {c: [texts[i].encode() for i in order if marks[i] == c][:3000] for c in (0, 1)}
    cut = {c: (len(of) + 1) // 2 for c, of in by.items()}
    held = {c: zstandard.ZstdCompressionDict(b"\n".join(of[: cut[c]]), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c, of in by.items()}
    packed = {c: zstandard.ZstdCompressor(dict_data=d, level=9, write_checksum=False, write_content_size=False, write_dict_id=False) for c, d in held.items()}
    saved = lambda t: sum(len(packed[0].compress(t[a : a + 2048])) - len(packed[1].compress(t[a : a + 2048])) for a in range(0, len(t), 2048))
    model = quality.fit(docs, labels, learn=quality.learnable())
    w, share = model.weights, np.mean([*marks.values()])
    rest = [(t, c) for c in (1, 0) for t in by[c][cut[c] :]]
    y = np.array([c for _, c in rest])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean = sum(g * 100 * saved(t) / len(t) for (t, _), g in zip(rest, weight)) / sum(weight)
    difference = lambda t: (100 * saved(t) + 32 * mean) / (len(t) + 32)
    x = np.array([difference(t) for t, _ in rest])
    weight, p = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())), 1 / (1 + np.exp(-w[0] - w[1] * x))
    # The loss is convex, so where its slope is 0 is its only minimum.
    assert abs((weight * (y - p)).sum()) < 1e-4 and abs((weight * (y - p) * x).sum() - 1e-3 * w[1]) < 1e-4
    for r in quality.with_score(docs, model).collect():
        t = (r["text"] or "").encode()
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-np.clip(w[0] + w[1] * difference(t), -30, 30))) if t else share, abs=1e-6)


def test_dictionaries_stay_within_reach(spark):
    """What a dictionary begins with is still found, however long the labelled texts are together."""
    rng = np.random.default_rng(8)
    texts = [(i, bytes(rng.integers(97, 123, 12_000).astype(np.uint8)).decode()) for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), labels)
    assert all(2_400_000 < len(d) <= 2_500_000 for d in (model.good, model.bad))
    for compressor, of in zip(model.compressors(), (model.good, model.bad)):
        first = of.split(b"\n")[0]
        assert all(len(compressor.compress(first[at : at + 2048])) < 100 for at in range(0, len(first), 2048))


def test_substrings_odd(odd, empty):
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(odd).collect()]
    by = {i: (n, gone) for i, n, gone, _ in rows}
    assert len(rows) == len(ROWS) and by[3] == by[4] == by[5] == (0, 0) and by[6] == (30_000, 0) and by[7] == (30_000, 30_000) and by[8] == (2, 0)
    assert substring.remove_repeats(empty).count() == 0


def test_busy_passages(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUSY", 3)
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join([*(f"x{j}" for j in rng.integers(0, 99, 9)), *passage[rng.integers(0, 9) : rng.integers(25, 40)], *(f"x{j}" for j in rng.integers(0, 99, 9))]) for _ in range(60)]
    got = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen: set = set()
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {j + d for j, g in enumerate(grams) if g in seen for d in range(13)}
        assert got[i] == " ".join(x for j, x in enumerate(w) if j not in gone)
        seen |= set(grams)


def test_suffix_automaton():
    automaton, texts = substring.SuffixAutomaton(), ["a b c a b d".split(), "b c a x".split(), "a b c a b d".split()]
    for t in texts:
        automaton.add(t)
    query = "z a b c a b x b c a x a".split()
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    assert automaton.statistics(query) == [max((n for n in range(1, i + 2) if tuple(query[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(query))]


def embeddings(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 16))
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.12
    x[100:120] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0], 1), (n + 4, [None] * 16, 1), (n + 5, [float("inf")] + [0.0] * 15, 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, links long"), u @ u.T


def test_multi_index(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LISTED", 16)
    monkeypatch.setattr(multi_index, "VISITING", 32)
    df, s = embeddings(spark)
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(df, centres=4).collect()}
    near = (s >= 0.95) & ~np.eye(len(s), dtype=bool)
    found = np.array([got[i]["n_links"] for i in range(len(s))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum() and (found[100:120] == 19).all()
    assert all(got[i]["component_id"] == 100 for i in range(100, 120)) and [got[i]["kept"] for i in (100, 101)] == [True, False]
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(400, 406)) and len(got) == 406
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(additive, "ROWS", 100)
    monkeypatch.setattr(additive, "QUERIES", 3)
    df, s = embeddings(spark)
    np.fill_diagonal(s, -2)
    got: dict = {}
    for r in additive.nearest(df, F.col("id") % 50 == 0, entries=16, rerank=60).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 400, 50)) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    best = {q: np.lexsort((np.arange(400), -s[q]))[:5].tolist() for q in got}
    assert sum(len(set(best[q]) & {v for v, _ in got[q].values()}) for q in got) >= 0.9 * 5 * len(got)
    assert [v for v, _ in (got[100][k] for k in range(1, 6))] == [101, 102, 103, 104, 105]
    assert all(abs(x - s[q, v]) < 1e-9 for q, g in got.items() for v, x in g.values())
    assert additive.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0 and additive.nearest(df.limit(2), F.col("id") % 50 == 0).count() == 1


def test_nearest_in_a_large_group(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32))
    x[:300] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(300, 32)) * 0.03
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got: dict = {}
    for r in additive.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, entries=16, rerank=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) == 45 and all(got[q] == set(np.argsort(-s[q])[:5].tolist()) for q in got)


def test_few_rows_are_compared(spark):
    """Each query alone prunes: on the given vectors all true neighbours are found from a twentieth of the rows."""
    table = queries.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    books = additive.codebooks(u, 16, 256)
    codes, norms, _ = additive.encode(u, books, 4)
    ask = ids % 50 == 0
    search = additive.Search(ids[ask], x[ask], books, 5, 32)
    for lo in range(0, len(ids), 700):
        part = slice(lo, lo + 700)
        search.see(ids[part], x[part], codes[part], norms[part], *(a[part] for a in additive.along(u, codes, norms, books)))
    s = u[ask] @ u.T
    s[ids[ask][:, None] == ids[None]] = -2
    assert all(set(best) == set(ids[np.argsort(-row)[:5]]) for (_, best), row in zip(search.best, s))
    assert search.compared < 0.05 * ask.sum() * len(ids)


def test_visits_without_links_in_the_sample(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95).sum() - len(x)
    found = multi_index.near_duplicates(df, centres=16, sample=120).agg(F.sum("n_links")).first()[0]
    assert found >= 0.97 * near


def test_license(spark, odd, empty):
    isc = license.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020, A. Body\n" + isc.upper().replace(" ", "\n  ")), (2, isc + " more"), (3, "licensed under the apache LICENCE version 2 0"), (4, None), (5, "")]
    got = {r["doc_id"]: r["license"] for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "ISC", 2: None, 3: "Apache-2.0-notice", 4: None, 5: None}
    assert license.scan(odd).count() == len(ROWS) and license.scan(empty).count() == 0


def test_license_with_titles_and_curly_quotes(spark):
    by, rows, want = dict(license.whole_texts()), [], []
    for name, titles in license.TITLES.items():
        for head in ("", *titles):
            for line in ("", "Copyright (c) 2021 A. Body\n\n") if "opyright (c)" not in by[name] else ("",):
                text = (head + "\n\n" if head else "") + line + by[name]
                rows += [text, text.replace('"', "\u201c").replace("'", "\u2019").replace(" - ", " \u2013 ")]
                want += [name] * 2
    for width in range(40, 121):
        rows.append("MIT License\n\nCopyright (c) 2020 X\n\n" + textwrap.fill(by["MIT"], width, break_on_hyphens=False, break_long_words=False))
        want.append("MIT")
    got = {r["doc_id"]: r["license"] for r in license.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i in range(len(rows)) if got[i] not in (want[i], "BSD-2-Clause" if "BSD License" in rows[i] else None)] == [] and sum(got[i] == w for i, w in enumerate(want)) == len(want)


def test_license_in_any_lines(spark):
    whole = license.whole_texts()
    assert {"BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0"} <= {name for name, _ in whole}
    rows, want = [], []
    for name, text in whole:
        cuts = [text, " ".join(text.split()), *(textwrap.fill(" ".join(text.split()), w, break_on_hyphens=False, break_long_words=False) for w in range(60, 81, 4))]
        if name in ("ISC", "MIT", "Zlib", "BSD-2-Clause") and "opyright (c)" not in text:
            cuts += [head + cut for cut in cuts for head in ("Copyright 2020 X ", "Copyright (c) 2019-2020, A. Body <a@b.c>\n", "Copyright The X Authors. All rights reserved.\n", "© 2020 X\n(c) 2021 Y\n\n")]
        rows += cuts
        want += [name] * len(cuts)
    rows += ["Copyright 2020 X. You may not sell copies. " + whole[2][1]]
    got = {r["doc_id"]: r["license"] for r in license.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i in range(len(rows))] == list(enumerate([*want, None]))


def test_license_below_other_lines(spark):
    whole = dict(license.whole_texts())
    heads = ["SPDX-License-Identifier: MIT\n\n", "// SPDX-License-Identifier: MIT\n// Copyright 2020 X\n\n", "Copyright, 2020, A. Body\n", "Portions Copyright (c) 2010 A. Body\nCopyright (c) 2020 X\n", "MIT License\n\nCopyright (c) 2021 A\nPortions copyright (c) 2022 B\n\n"]
    rows = [(i, head + whole["MIT"]) for i, head in enumerate(heads)]
    rows += [(100, "SPDX-License-Identifier: MIT"), (101, "copyright notices and patents\n" + whole["MIT"])]
    got = {r["doc_id"]: r["license"] for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "MIT" for i in range(len(heads))} | {100: None, 101: None}


def test_license_very_long_texts(spark):
    rows = [(1, "Copyright 2020 a\n" * 200_000), (2, "copyright (c) 2020\n" * 200_000), (3, dict(license.whole_texts())["GPL-3.0"] + "\nword" * 500_000)]
    began = time.time()
    assert [r["license"] for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [None] * 3
    assert time.time() - began < 30


def plain_classes(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (1, 60)])
def test_ngram_join(spark, monkeypatch, k, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = np.random.default_rng(k)
    rows, base = [], [f"w{j}" for j in rng.integers(0, 300, 80)]
    for i in range(120):
        if i % 3:
            text = list(base)
            for j in rng.integers(0, 80, rng.integers(0, 6)):
                text[j] = f"w{rng.integers(0, 300)}"
            base = text if i % 7 == 0 else base
        else:
            text = [f"w{j}" for j in rng.integers(0, 300, rng.integers(0, 90))]
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()}
    assert got == plain_classes(rows, k, percent)


def test_ngram_join_odd(odd, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(odd, k=3, percent=90).collect()]
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == len(ROWS) and by[3] == (0, 3) and by[5] == (0, 5) and by[7][1] == 6 and by[8] == (1, 8) and by[None] == (1, None)
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_pipeline_of_nothing(spark, sf_dir, empty):
    rows = empty.select("doc_id", "text", "lang", "source", "n_chars", "key", "kept")
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialise(stage(spark, rows, sf_dir), name)
        assert rows.count() == 0


def plain_split(children, budget):
    """{name: (weight, room)} to {name: share}."""
    order = sorted((c for c in children.items() if c[1][0] > 0 and c[1][1] > 0), key=lambda c: (c[1][1] / c[1][0], c[0]))
    budget, out = min(budget, sum(room for _, (_, room) in order)), {}
    while order and order[0][1][1] * sum(w for _, (w, _) in order) <= budget * order[0][1][0]:
        name, (_, out[name]) = order.pop(0)
        budget -= out[name]
    at, total = 0, sum(w for _, (w, _) in order)
    for name, (w, _) in order:
        out[name] = budget * (at + w) // total - budget * at // total
        at += w
    return out


def plain_mix(rows, share):
    """Rows (doc_id, text, lang, source) that are taken in one epoch; rows of one leaf and id are alike here, and go together."""
    weight, leaves = (lambda level, x: queries.WEIGHTS[level].get(x, 1)), {}
    for r in rows:
        number = re.search("[0-9]+", r["source"] or "")
        leaves.setdefault((f"d{int(number[0]) % 3}" if number else "", r["lang"] or "", r["source"] or ""), []).append(r)
    room = {leaf: sum(len(words(r["text"])) for r in of) for leaf, of in leaves.items()}
    under = lambda *head: sum(n for leaf, n in room.items() if leaf[: len(head)] == head)
    out = []
    for d, given in plain_split({d: (weight("domain", d), under(d)) for d, _, _ in leaves}, int(sum(room.values()) * share)).items():
        for lang, part in plain_split({x: (weight("language", x), under(d, x)) for e, x, _ in leaves if e == d}, given).items():
            for source, left in plain_split({x: (weight("source", x), under(d, lang, x)) for e, y, x in leaves if (e, y) == (d, lang)}, part).items():
                of = leaves[d, lang, source]
                if left == room[d, lang, source]:
                    out += of
                    continue
                key = lambda r: hashlib.md5(":".join(["7", "0", hashlib.md5((r["text"] or "").encode()).hexdigest() if r["doc_id"] is None else str(r["doc_id"])]).encode()).hexdigest()
                last = None
                for r in sorted(of, key=lambda r: (key(r), r["doc_id"] is not None, r["doc_id"] or 0)):
                    n = len(words(r["text"]))
                    if n and (left > 0 or (r["doc_id"], r["text"]) == last):  # equal rows go together
                        out.append(r)
                        last = (r["doc_id"], r["text"])
                    left -= n
    return out


def plain_substrings(rows):
    first: dict = {}
    grams = lambda w: [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
    for r in rows:
        if r["doc_id"] is not None:
            for g in grams(words(r["text"])):
                first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    for r in rows:
        w = words(r["text"])
        gone = {j + d for j, g in enumerate(grams(w)) if r["doc_id"] is not None and first[g] < r["doc_id"] for d in range(13)}
        if not gone or len(gone) < len(w):
            text = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else r["text"]
            yield {**r, "text": text, "n_chars": len(text) if gone else r["n_chars"]}


def plain_near_duplicates(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    classes = plain_classes([(i, of[0]["text"]) for i, of in by.items() if i is not None], 5, 80)
    return [r for i, of in by.items() for r in (of if i is None else of[:1] if classes[i][1] == i else [])]


OWN = "kept string, n_words int, score string, component_id double, size map<string,int>"


@pytest.fixture(scope="module")
def odd_corpus(spark, sf_dir, tmp_path_factory):
    """A folder with the documents of sf_dir, more odd rows, and columns whose names clash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = docs.where("length(text) > 900").orderBy("doc_id").first()["text"]
    more = [(None, text), (None, text), (None, "no id at all"), (None, None), (None, ""), (800_001, None), (800_002, ""), (800_003, text), (800_004, "lead " + text), (800_005, LONG), (800_006, LONG + " and more"), (800_007, "a b"), (800_007, "a b")]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    own = ("'own' as kept", "7 as n_words", "'s' as score", "0.5D as component_id", "map('a', 1) as size")
    path = str(tmp_path_factory.mktemp("odd") / "sf")
    docs.unionByName(more).selectExpr("*", *own).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_equals_plain_stages(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    plain = lambda df: [r.asDict() for r in df.collect()]
    same = lambda rows: Counter(str(sorted(r.items())) for r in rows)
    rows, at = plain(docs), docs
    model = quality.fit(docs, spark.read.parquet(f"{odd_corpus}/labels.parquet"), learn=quality.learnable())
    steps = {
        "quality": lambda rows: [r for r in rows if model.score([(r["text"] or "").encode()])[0] >= 0.7],
        "near_duplicates": plain_near_duplicates,
        "substrings": plain_substrings,
        "mixing": lambda rows: plain_mix(rows, corpus_pipeline.MIX_SHARE),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = len(rows), list(steps[name](rows))
        at = corpus_pipeline.materialise(stage(spark, at, odd_corpus), name)
        assert at.columns == docs.columns and same(plain(at)) == same(rows) and 0 < len(rows) <= before, name
        assert any(r["doc_id"] is None for r in rows), name
    repeats = corpus_pipeline.substring_stage(spark, docs, odd_corpus)
    assert same(plain(repeats)) == same(plain_substrings(plain(docs))) and repeats.count() < docs.count()
    got = corpus_pipeline.run(spark, odd_corpus).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pieces([(r["doc_id"], r["text"]) for r in rows])
    held_together(got)


def test_mixing_stage(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = [(None, "no id at all", "en", "src0"), (None, "no id at all", "en", "src0"), (None, "none here", "de", "own"), (7, "same id, other leaf", "fr", "src4"), (None, "", "de", "own"), (900_001, "", "en", "src1"), (900_002, None, None, None)]
    rows = first.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(other, "doc_id long, text string, lang string, source string"))
    got = corpus_pipeline.mixing_stage(spark, rows, sf_dir).collect()
    want = plain_mix(rows.collect(), corpus_pipeline.MIX_SHARE)
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and any(r["doc_id"] is None for r in got)


def test_near_duplicate_stage_keeps_rows_without_an_id(spark, sf_dir, odd):
    got = sorted((r["doc_id"] or 0 for r in corpus_pipeline.near_duplicate_stage(spark, odd, sf_dir).collect()))
    texts = [(r[0], r[1]) for r in {r[0]: r for r in ROWS if r[0] is not None}.values()]
    assert got == [0, *(i for i, (_, c) in plain_classes(texts, 5, 80).items() if i == c)]


def test_ids_that_repeat_with_other_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16))
    x[12], x[30], x[31] = rng.normal(size=16), x[13] + 1e-6, x[13] + 2e-6
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[11].tolist()), (50, x[12].tolist()), (7, x[8].tolist()), (7, x[8].tolist()), (50, None)]
    got = {}
    for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), centres=4).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    assert got[11] == {(1, 11, True)} and got[12] == {(1, 11, False)} and got[50] == {(2, 11, False)}
    assert got[8] == {(2, 7, False)} and {r[1:] for r in got[7]} == {(7, True)} and got[13] == {(2, 13, True)} and got[31] == {(2, 13, False)}
    assert all(got[i] == {(0, i, True)} for i in range(40) if i not in (7, 8, 11, 12, 13, 30, 31))


@pytest.mark.parametrize("centres", [32, 256])
def test_visits_find_links_just_at_the_threshold(centres):
    """Isotropic vectors, pairs of cosine 0.953 in directions that the visits were not fixed by."""
    rng = np.random.default_rng(centres)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    grid = multi_index.Grid(unit(rng.standard_normal((12_000, 64))), centres)
    grid.visits = multi_index.at_the_edge(grid, unit(rng.standard_normal((1024, 64))), 0.95, 0.98)
    a = unit(rng.standard_normal((2000, 64)))
    z = rng.standard_normal(a.shape)
    b = 0.953 * a + (1 - 0.953**2) ** 0.5 * unit(z - (z * a).sum(1, keepdims=True) * a)
    of_a, of_b = (grid.order(x, grid.visits) for x in (a, b))
    found = (of_a == of_b[:, :1]).any(1) | (of_b == of_a[:, :1]).any(1)
    assert found.mean() >= 0.97 and grid.visits < grid.cells / 20


def test_words_that_are_not_held_are_encoded_again(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    # Two workers of an executor, and the JVM beside them, have 3,000 MB.
    assert (packing.WORDS_HELD + packing.PARTS_HELD) * 160 < 150 << 20
    path = public_tokenizers.path("word_bpe_49k.json")
    for name, value in (("WORDS_HELD", 3), ("PARTS_HELD", 2), ("AT_ONCE", 4), ("_encoders", {})):
        monkeypatch.setattr(packing, name, value)
    encode, plain = packing.word_encoder(path), Tokenizer.from_file(path)
    words = "The cat's Café, sat\xa0 İstanbul ΣΑΣ ́x 가각 가 日本! 😀👨‍👩 ½ \x85 12,5 don't ... a b".split(" ")
    for at in range(len(words)):
        text = "\t".join(words[at:] + words)
        assert encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encode("") == encode(" \n") == b""


def test_another_step_lets_go_of_the_encoders():
    """Spark hands a worker on: what packing remembered counted against the steps after it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.record_batch({"id": pa.array([1]), "text": pa.array(["a few words"])})
    first = list(packing.piece_rows(path, 8)([batch]))
    encode = packing._encoders[path]
    assert list(packing.piece_rows(path, 8)([batch])) == first and packing._encoders[path] is encode  # from task to task
    list(substring.anchor_rows(13, 6)([batch]))
    assert not packing._encoders
    assert list(packing.piece_rows(path, 8)([batch])) == first


def test_substring_tables_are_as_large_as_their_keys_need(spark, monkeypatch):
    bits, plain = [], substring.bit_table
    monkeypatch.setattr(substring, "bit_table", lambda keys, column, bits_=27: bits.append(bits_) or plain(keys, column, bits_))
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {passage}"), (2, f"{passage} y")], "doc_id long, text string")
    rows = {r.doc_id: r.kept for r in substring.remove_repeats(docs).collect()}
    assert rows == {1: f"x {passage}", 2: "y"}
    assert len(bits) == 3 and max(bits) < 20  # anchors, busy anchors, wanted segments


def test_a_word_of_many_rows_is_encoded_once_whatever_is_held(monkeypatch):
    import tokenizers

    seen: list[str] = []

    class Counting:
        def __init__(self, own) -> None:
            self.own = own

        @staticmethod
        def from_file(path: str):
            return Counting(plain.from_file(path))

        def encode(self, text: str, **named):
            seen.extend(text.split())
            return self.own.encode(text, **named)

    plain = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    for name, value in (("WORDS_HELD", 0), ("PARTS_HELD", 0), ("_encoders", {})):
        monkeypatch.setattr(packing, name, value)
    path, words = public_tokenizers.path("word_bpe_49k.json"), [f"{a}añá{b}" for a in "bcdfg" for b in "klmnp"]
    rows = [" ".join(f"{w.capitalize() if n % 2 else w}{mark * (n % 3)}" for w in words) for n, mark in enumerate("#.&*,!" * 20)]
    batch = pa.record_batch({"id": pa.array(range(len(rows))), "text": pa.array(rows)})
    found = [tuple(r.values()) for out in packing.piece_rows(path, 2048)([batch]) for r in out.to_pylist()]
    assert len(seen) <= len(words) + 12  # marks alone, besides
    assert sorted(found, key=str) == plain_pieces(list(enumerate(rows)))


def test_words_are_cut_only_where_the_tokenizer_cuts(monkeypatch):
    """Also where letters compose with what follows, beside contractions and added tokens, and in rows longer than a chunk."""
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(3)
    some = [*"abxyzABJKst \t\n\r.,;:!?#$&*()-_[]{}@^`~\"'/\\%+=<>|01½ªéÉñß×÷ÿÀΣς日가ᄀ😀", *"̸̧́̌̇ͅK`;\x85\xa0\x1c\x00 "]
    some += ["'s", "'re", "'T", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
    texts = ["".join(rng.choice(some, rng.integers(0, 30))) for _ in range(4000)]
    texts += [" ".join(texts[:50]), "x" * 300, "x" * 100 + " " + "y" * 100 + " " * 100, " " * 300, "é" * 200 + "# a"]
    expected = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        monkeypatch.setattr(packing, "_encoders", {})
        encoder = packing.word_encoder(path)
        assert isinstance(encoder, packing.WordEncoder)
        assert list(encoder.texts(pa.array(texts))) == expected
        assert list(encoder.texts(pa.array([None, *texts, None]).slice(1, len(texts)))) == expected
        assert list(encoder.texts(pa.array([None], pa.string()))) == [b""]
