import numpy as np

from quizloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def plain(rows, top=4):
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in rows], object)
    once = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(once), once.sum(0)
    centred = once.astype(float) - sums.astype(float) / n
    e, p = np.linalg.eigh(centred.T @ centred / n)
    e, p = e[::-1], p[:, ::-1]
    k = [j for j in range(min(top, len(e))) if e[j] > 1e-12 * e[0]]
    deviation = [int(((n * row - sums) ** 2).sum()) for row in x]
    return n, deviation, (x.astype(float) - sums.astype(float) / n) @ p[:, k] / np.sqrt(e[k]), e[k] / e.sum()


def held(rows, got):
    n, deviation, want, explained = plain(rows)
    assert len(got) == want.size and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, deviation[i]))
    for j in range(want.shape[1]):
        part = got[got["component"] == j + 1].sort_values(["vec_id", "deviation"], na_position="first")
        assert [None if i != i else int(i) for i in part["vec_id"]] == [rows[i][0] for i in order]
        assert part["deviation"].tolist() == [deviation[i] for i in order]
        own, found = want[order, j], part["whitened"].to_numpy()
        assert np.abs(own * np.sign(own @ found) - found).max() < 1e-9  # either sign, the same for all
        assert np.allclose(part["explained"], explained[j], rtol=1e-10)


def test_equals_the_covariances_eigenvectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((200, 7)) * [3, 2.5, 2, 1.5, 0.5, 0.2, 0])]
    rows += [(3, rows[5][1]), (None, rows[6][1]), (500, [0.0] * 7)] + [(1000 + i, rows[9][1]) for i in range(100)]  # a third are one vector
    odd = [(600, None), (601, [float("nan")] * 7), (602, [1.0] * 6 + [None]), (603, [float("inf")] * 7), (604, [1.0, 2.0]), (605, []), (606, [1e30] * 7)]
    held(rows, whitening.whitened(frame(spark, rows + odd)).toPandas())


def test_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    held(rows, whitening.whitened(table).toPandas())


def test_equal_spreads_and_small_rank(spark):
    # Two components of equal spread each: any of their rotations is right, none may be missed.
    rows = [(i, [float(c) for c in np.eye(6)[i % 6] * (5 if i % 6 < 2 else 3) * (1 if i % 12 < 6 else -1)]) for i in range(24)]
    got = whitening.whitened(frame(spark, rows)).toPandas()
    first = got.groupby("component")["explained"].first()
    assert np.allclose(first, [25 / 86, 25 / 86, 9 / 86, 9 / 86]) and got["identity_error"].max() < 1e-9
    line = [(i, [float(i), float(2 * i), 0.0, 1.0, 5.0]) for i in range(9)]
    got = whitening.whitened(frame(spark, line)).toPandas()
    assert set(got["component"]) == {1} and np.allclose(got["explained"], 1)
    two = whitening.whitened(frame(spark, [(1, [1.0]), (2, [2.0])])).toPandas()
    assert sorted(two["whitened"].round(9)) == [-1, 1] and set(two["n"]) == {2}


def test_no_spread(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whitened(frame(spark, rows)).count() == 0


def test_deviations_are_exact():
    big = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening.deviations(big, 7, np.array([5, 6], object)) == [None, (21 - 5) ** 2 + (28 - 6) ** 2]
    assert whitening.deviations(np.array([[3, 4]]), 7, np.array([5, 6], object)) == [(21 - 5) ** 2 + (28 - 6) ** 2]
    near = np.array([[(1 << 31) - 1]])
    assert whitening.deviations(near, 1, np.array([0], object)) == [((1 << 31) - 1) ** 2]
