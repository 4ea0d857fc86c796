import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quizloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def are_near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def plain_variants(rows, least=7, times=2, ratio=10):
    counts = Counter()
    for id_, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    counts = {w: n for w, n in counts.items() if n >= times}
    near = {w: [v for v in counts if are_near(w, v)] for w in counts}
    forms = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v)) if some else None
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, form in forms.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, form, root, counts[w], len(near[w]), counts[form] if form else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def same(spark, rows):
    got = [tuple(r) for r in spelling.variants(frame(spark, rows)).collect()]
    want = plain_variants(rows)
    assert len(got) == len(want) and set(got) == want
    return want


@pytest.mark.parametrize("large", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(spelling, "LARGE", large)
    monkeypatch.setattr(spelling, "HELD", 40)
    monkeypatch.setattr(spelling, "RUN", 30)
    rng = random.Random(1)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.choice([6, 7, 8, 9, 10]))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(base[: 1 + int(150 * rng.random() ** 3)]) for _ in range(60)) + ", X") for i in range(60)]
    want = same(spark, rows)
    assert sum(r[4] for r in want) > 20 and any(r[1] for r in want)


def test_chains_ties_and_odd_texts(spark):
    often = lambda word, n: " ".join([word] * n)
    rows = [
        (1, " ".join([often("abcdefgh", 300), often("abcdefgx", 30), often("abcdeXgx", 3)])),  # a chain of three
        (1, often("abcdefgh", 2)),
        (None, "ÀBCDEFGH Àbcdefgh ÀBCDEFGH"),
        (3, None),
        (4, ""),
        (5, "short words only x"),
        (6, "tievariant " * 40 + "tiexariant " * 40 + "tieyariant " * 2),  # a tie goes to the smaller
        (7, ("a" * 5000 + " ") * 30 + ("a" * 4999 + "b ") * 2 + "a" * 5001 + " " + "a" * 5001),  # words of any length
        (8, "aaaaaaa " * 50 + "aaaaaaaa " * 3),  # a letter put in anywhere of a run
    ]
    want = same(spark, rows)
    roots = {r[0]: (r[1], r[2]) for r in want}
    assert roots["abcdexgx"] == ("abcdefgx", "abcdefgh") and roots["tieyariant"][0] == "tievariant"
    assert spelling.variants(frame(spark, [])).count() == 0


def test_a_third_of_the_words_share_a_half(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LARGE", 64)
    rng = np.random.default_rng(3)
    tails = ["".join("abcdefghij"[c] for c in rng.integers(0, 10, 4)) for _ in range(400)]
    words = [f"same{t}" for t in tails] + ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(800)]
    rows = [(i, " ".join(words * 2)) for i in range(2)]
    want = same(spark, rows)
    shards = spelling.shards(spelling.vocabulary(frame(spark, rows)), 7).where("hi - lo > 1").groupBy(*spelling.KEY).count()
    assert shards.agg({"count": "max"}).first()[0] <= 64 and sum(r[4] for r in want) > 100


def test_bitsets_find_pairs_across_blocks():
    words = sorted({f"{a}{b}cdefg"[:7] for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"} | {f"a{c}xcdefg" for c in "abcdefghijklmnop"})
    words = [w for w in words if len(w) in (7, 8)]
    text = spelling.letters(words, 8)
    first, last = np.zeros(len(words), int), np.full(len(words), len(words))
    q, t = spelling.near(text, text[:, 7] > 0, first, last)
    got = {(words[a], words[b]) for a, b in zip(q, t)}
    assert got == {(a, b) for a in words for b in words if len(a) == 7 and a != b and are_near(a, b)} and len(words) > 128
