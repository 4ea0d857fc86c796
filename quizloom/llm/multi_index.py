"""Near-duplicate vectors through an inverted multi-index.

Codebooks of either half of the vectors, fitted on a bounded sample, span a grid of cells. A vector
is listed in the cell of its nearest centres and visits cells in order of the sum of its distances
to their two centres (the multi-sequence order), as many as bring the wanted recall on the links of
a bounded set of vectors, which are compared with all rows. Where these meet few links or none, visits are still enough for
links just at the threshold: to each of those vectors another is made that lies there in a random direction, and the visits find
`edge_recall` of these. What lies in a visited cell is verified by cosine in double precision.

Equal vectors are one row with a weight. A busy cell is split into blocks of listed and of
visiting vectors, so no task gets more than one block of each. A block returns a row per vector with links:
how many, and a root of its local component, never the pairs themselves.

Vectors that are null, zero or of another length than most, hold null or non-finite components or
have a null id link with nothing. Repeated rows link with each other. Rows that repeat an id with other vectors are one
document: its links are those of all its vectors, and whatever links with one of them is in their component. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.common import components, materialise, tidy
from quizloom.llm.vectors import bounded_sample, distances, k_means, matrix, unit, usable

LISTED, VISITING = 1024, 4096
#: Vectors compared with all rows to fix the visits, and the fewest visits.
ASKED, LEAST = 1024, 8
#: Vectors that a cell is to list, and the fewest centres of a half.
CELL, LEAST_CENTRES = 256, 32


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, centres: int) -> None:
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [k_means(x, centres) if x.shape[1] else np.zeros((1, 0)) for x in (sample[:, : self.cut], sample[:, self.cut :])]
        self.cells = len(self.books[0]) * len(self.books[1])
        self.visits = min(LEAST, self.cells)

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Each row's cells, nearest first; a cell is first centre * second book's size + second centre."""
        both = [distances(h, b) for h, b in zip((x[:, : self.cut], x[:, self.cut :]), self.books)]
        # The n-th cell has no centre beyond the n-th nearest of its half.
        tops = [np.argsort(d, axis=1, kind="stable")[:, :visits] for d in both]
        a, b = (np.take_along_axis(d, t, 1) for d, t in zip(both, tops))
        sums = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        i, j = np.divmod(first, tops[1].shape[1])
        return np.take_along_axis(tops[0], i, 1) * len(self.books[1]) + np.take_along_axis(tops[1], j, 1)

    def rank(self, x: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The place of each cell in the order of its row of x: how many cells are nearer."""
        a, b = (distances(h, book) for h, book in zip((x[:, : self.cut], x[:, self.cut :]), self.books))
        in_order = np.sort(b, axis=1)
        i, j = np.divmod(cell, len(self.books[1]))
        room = (a[row, i] + b[row, j])[:, None] - a[row]
        return np.array([np.searchsorted(in_order[r], m).sum() for r, m in zip(row, room)], np.int64)


def at_the_edge(grid: Grid, asked: np.ndarray, threshold: float, recall: float, turns: int = 4) -> int:
    """Cells to visit so that a vector just at the threshold, in a random direction, is found from either end."""
    rng, n = np.random.default_rng(0), []
    for _ in range(turns):
        z = rng.standard_normal(asked.shape)
        z = z - (z * asked).sum(1, keepdims=True) * asked
        size = np.sqrt((z * z).sum(1, keepdims=True))
        other = threshold * asked + np.sqrt(max(0.0, 1 - threshold**2)) * z / np.maximum(size, 1e-300)
        row = np.arange(len(asked))
        n.append(np.minimum(grid.rank(asked, row, grid.order(other, 1)[:, 0]), grid.rank(other, row, grid.order(asked, 1)[:, 0])))
    n = np.sort(np.concatenate(n))
    return int(n[min(len(n) - 1, int(np.ceil(recall * len(n))) - 1)]) + 1


def enough(grid: Grid, classes: DataFrame, threshold: float, recall: float, edge_recall: float) -> int:
    """Cells to visit so that links of up to ASKED vectors with all rows are found from either end."""
    asked = bounded_sample(classes, ASKED)
    least = max(grid.visits, at_the_edge(grid, asked, threshold, edge_recall))
    shared = classes.sparkSession.sparkContext.broadcast((grid, asked, grid.order(asked, 1)[:, 0]))

    def linked(batches):
        grid, asked, home = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                x = unit(matrix(batch.column("v").slice(lo, 512)))
                i, q = np.nonzero(x @ asked.T >= threshold)
                other = (x[i] != asked[q]).any(1)
                i, q = i[other], q[other]
                if len(i):
                    own = grid.order(x, 1)[:, 0]
                    # Near vectors lie in few cells, so each row and cell is asked for once.
                    there, back = np.unique(np.stack([i, home[q]]), axis=1, return_inverse=True)
                    here, forth = np.unique(np.stack([q, own[i]]), axis=1, return_inverse=True)
                    best = np.minimum(grid.rank(x, *there)[back.ravel()], grid.rank(asked, *here)[forth.ravel()])
                    rank, n = np.unique(best, return_counts=True)
                    yield pa.record_batch({"rank": pa.array(rank, pa.int64()), "n": pa.array(n, pa.int64())})

    found = classes.select("v").mapInArrow(linked, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").toArrow()
    if not found.num_rows:
        return least
    n = np.cumsum(found["n"].to_numpy())
    return max(least, int(found["rank"].to_numpy()[np.searchsorted(n, recall * n[-1])]) + 1)


def block_links(threshold: float):
    """Links between a block's listed and visiting vectors.

    A pair may be found from either end; it is counted here unless it is also found in the other
    vector's cell and the visitor has the larger id.
    """
    kind = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def rows(table: pa.Table) -> pa.Table:
        visiting = table["visiting"].to_numpy()
        ids, weight, home = (table[c].to_numpy() for c in ("id", "weight", "home"))
        x = unit(matrix(table["v"]))
        visits = table["visits"].combine_chunks()
        visits = visits.flatten().to_numpy().reshape(len(ids), -1)
        listed, visitors = np.flatnonzero(~visiting), np.flatnonzero(visiting)
        found = []
        for lo in range(0, len(visitors), 512):
            some = visitors[lo : lo + 512]
            i, j = np.nonzero(x[some] @ x[listed].T >= threshold)
            found.append(np.stack([some[i], listed[j]]))
        q, y = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        keep = ids[q] != ids[y]
        q, y = q[keep], y[keep]
        if not len(q):
            return kind.empty_table()
        twice = (visits[y] == home[q][:, None]).any(1)
        counted = ~twice | (ids[q] < ids[y])
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, q[counted], weight[y[counted]])
        np.add.at(links, y[counted], weight[q[counted]])
        root = ids.copy()
        while True:
            old = root.copy()
            least = np.minimum(root[q], root[y])
            np.minimum.at(root, q, least)
            np.minimum.at(root, y, least)
            if (root == old).all():
                break
        some = np.unique(np.r_[q, y])
        return pa.table({"id": ids[some], "links": links[some], "root": root[some]}, kind)

    return rows


@tidy
def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.995, edge_recall: float = 0.98, centres: int | None = None, sample: int = 20_000) -> DataFrame:
    """A row per row of rows: id, n_links, component_id, kept. Without centres, as many as leave CELL vectors
    to a cell, LEAST_CENTRES at least and a quarter of the sample at most."""
    good = usable(rows, id_col, vector_col).withColumn("class", F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b")))
    good = materialise(good, "vectors")
    classes = materialise(good.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.any_value("v").alias("v")), "classes")
    vectors, grid = classes.select(F.col("rep").alias("id"), "v"), None
    if n := classes.count():
        grid = Grid(bounded_sample(vectors, sample), centres or min(max(LEAST_CENTRES, int((n / CELL) ** 0.5)), sample // 4))
        grid.visits = enough(grid, vectors, threshold, recall, edge_recall)
    shared = rows.sparkSession.sparkContext.broadcast(grid)

    def indexed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cells = shared.value.order(unit(matrix(part.column("v"))), shared.value.visits).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[:, 0].copy()), visits], [*part.schema.names, "home", "visits"])

    index = classes.select(F.col("rep").alias("id"), "weight", "v").mapInArrow(indexed, f"id long, weight long, v {classes.schema['v'].dataType.simpleString()}, home int, visits array<int>")
    index = materialise(index, "index")
    # Sizes of cells: at most centres * centres rows.
    listed = index.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / LISTED).cast("int").alias("lists"))
    visiting = index.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / VISITING).cast("int").alias("calls"))
    cells = F.broadcast(materialise(listed.join(visiting, "cell"), "cells"))
    salt = F.abs(F.xxhash64("id", F.lit("block")) % (1 << 30))
    a = index.withColumn("cell", F.col("home")).join(cells, "cell").withColumns({"list": (salt % F.col("lists")).cast("int"), "call": F.explode(F.sequence(F.lit(0), F.col("calls") - 1)), "visiting": F.lit(False)})
    b = index.withColumn("cell", F.explode("visits")).join(cells, "cell").withColumns({"call": (salt % F.col("calls")).cast("int"), "list": F.explode(F.sequence(F.lit(0), F.col("lists") - 1)), "visiting": F.lit(True)})
    found = a.unionByName(b).groupBy("cell", "list", "call").applyInArrow(block_links(threshold), "id long, links long, root long")
    found = materialise(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # Rows that repeat an id with other vectors are in several classes, which it links.
    again = materialise(good.select("id", "class").distinct().groupBy("id").count().where("count > 1").select("id"), "again")
    again = good.join(again, "id", "left_semi").join(classes.select("class", "rep"), "class").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(again))
    # A vector of an id: its class, or all classes that the id itself stands for.
    member = good.select("id", "class").distinct().join(classes.select("class", "rep", "weight"), "class").groupBy("id", "rep").agg(F.sum(F.col("weight") - 1).alias("copies"))
    member = member.join(materialise(links, "links").withColumnRenamed("id", "rep"), "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    member = member.groupBy("id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("copies")).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id")
    )
    out = rows.select(F.col(id_col).cast("long").alias("id")).join(materialise(member, "member"), "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)
