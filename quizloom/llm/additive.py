"""Approximate nearest neighbours by additive quantisation.

A vector of unit length is the sum of one entry of each of several full-dimensional codebooks,
fitted stage by stage to the residuals of a bounded sample, plus an error. Beam search chooses the
entries: it keeps the few best partial sums at each stage. Every row is stored as its codes, the
norm of its sum, and how much of it lies along that sum and across it. A query's inner products with all entries are a lookup table; a row's score is
the sum of its codes' products over its norm, times what lies along. The best of a batch of rows by that score are reranked by
cosine in double precision on the original vectors; so is every row that can still be among a query's k best so far,
since what lies across adds its length at most, less the more the query lies along the sum. So none is lost, however many near copies there are.
Ties go to the smaller id.

Queries are taken in blocks of bounded size. A block goes to every task that reads the index, once for each
part of it; no row of the index is copied or exchanged, and a task returns no more than k rows a query.

Vectors that are null, zero or of another length than most, hold null or non-finite components or
have a null id take no part. Rows that repeat a query's id are that query's own; of rows that repeat
another id the nearest counts. Extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm.common import lean, materialise, tidy
from quizloom.llm.vectors import bounded_sample, distances, k_means, matrix, scaled, unit, usable

#: Rows that a task compares at once, and about how many queries a block has.
ROWS, QUERIES = 8192, 8192


def codebooks(sample: np.ndarray, stages: int, entries: int) -> list[np.ndarray]:
    out, left = [], sample
    for stage in range(stages):
        book = k_means(left, entries, rounds=6, seed=stage)
        out.append(book)
        left = left - book[distances(left, book).argmin(1)]
    return out


def encode(x: np.ndarray, books: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each row by beam search, the norms of what they add up to, and those of the error."""
    n, d = x.shape
    left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        width = left.shape[1]
        far = distances(left.reshape(-1, d), book).reshape(n, -1)
        keep = min(beam, far.shape[1])
        best = np.argpartition(far, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)
        from_, entry = np.divmod(best, len(book))
        left = np.take_along_axis(left, np.repeat(from_[:, :, None], d, 2), 1) - book[entry] if width > 1 else left - book[entry]
        codes = np.concatenate([np.take_along_axis(codes, np.repeat(from_[:, :, None], codes.shape[2], 2), 1), entry[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0], np.sqrt(((x - left[:, 0]) ** 2).sum(1)), np.sqrt((left[:, 0] ** 2).sum(1))


def along(x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors, what lies along the sum of their entries, and the length of the rest."""
    sums = sum((book[codes[:, m]] for m, book in enumerate(books)), np.zeros_like(x))
    part = (x * sums).sum(1) / np.maximum(norms, 1e-300)
    return part, np.sqrt(np.maximum(1 - part * part, 0))


class Search:
    """A block of queries that sees rows batch by batch and keeps each query's k best, one a row id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, books: list[np.ndarray], k: int, rerank: int) -> None:
        self.ids, self.x, self.units = ids, scaled(vectors), unit(vectors)
        self.size = np.sqrt((self.x * self.x).sum(1))
        self.books, self.k, self.rerank, self.compared = books, k, rerank, 0
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        self.least = np.full(len(ids), -2.0)  # of the k-th best so far

    def keep(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.best[i][0], score], np.r_[self.best[i][1], ids]
        order = np.lexsort((ids, -score))
        _, first = np.unique(ids[order], return_index=True)  # an id's nearest row
        order = order[np.sort(first)[: self.k]]
        self.best[i] = score[order], ids[order]
        if len(order) == self.k:
            self.least[i] = score[order[-1]]

    def see(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, part: np.ndarray, rest: np.ndarray) -> None:
        x = scaled(vectors)
        size = np.sqrt((x * x).sum(1))

        def exact(i: int, near: np.ndarray) -> None:
            self.compared += len(near)
            self.keep(i, (x[near] * self.x[i]).sum(1) / (size[near] * self.size[i]), ids[near])

        for lo in range(0, len(self.ids), 64):
            q = self.units[lo : lo + 64]
            score = sum((q @ book.T).astype(np.float32)[:, codes[:, m]] for m, book in enumerate(self.books)) / np.maximum(norms, 1e-12).astype(np.float32)
            most = score * part + np.sqrt(np.maximum(1 - score * score, 0)) * rest + 1e-5
            other = self.ids[lo : lo + 64, None] != ids[None]
            score = np.where(other, score * part, -np.inf)
            first = np.argpartition(-score, self.rerank - 1, axis=1)[:, : self.rerank] if self.rerank < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
            for j, near in enumerate(first):
                i = lo + j
                near = near[other[j, near] & (most[j, near] >= self.least[i])]
                if len(near):
                    exact(i, near)
                may = np.flatnonzero((most[j] >= self.least[i]) & other[j])
                may = may[~np.isin(may, near)]
                if len(may):
                    exact(i, may)

    def found(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        score, ids = (np.concatenate([b[c] for b in self.best]) if len(self.best) else np.empty(0) for c in (0, 1))
        return pa.record_batch({"query_id": pa.array(np.repeat(self.ids, n), pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


@tidy
def nearest(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, stages: int = 16, entries: int = 256, beam: int = 4, rerank: int = 32, sample: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where queries (over the column id) holds, the k nearest others found."""
    good = materialise(usable(rows, id_col, vector_col), "vectors")
    n, asked = good.agg(F.count("*"), F.count_if(queries)).first()
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(codebooks(bounded_sample(good, sample), stages, entries) if n else [])

    def coded(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = unit(matrix(part.column("v")))
                codes, norms, _ = encode(x, shared.value, beam)
                own, rest = along(x, codes, norms, shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(own), pa.array(rest)], [*part.schema.names, "codes", "norm", "own", "rest"])

    index = materialise(good.mapInArrow(lean(coded), f"id long, v {good.schema['v'].dataType.simpleString()}, codes binary, norm double, own double, rest double"), "index")

    def searched(block):
        def rows(batches):
            ids, vectors = block.value
            search = Search(ids, vectors, shared.value, k, rerank)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    search.see(part.column("id").to_numpy(), matrix(part.column("v")), codes, *(part.column(c).to_numpy() for c in ("norm", "own", "rest")))
            yield search.found()

        return lean(rows)

    blocks, found = asked // QUERIES + 1, []
    for b in range(blocks):
        # A block of about QUERIES queries, so it can pass the driver.
        some = index.where(queries & (F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == b)).select("id", "v").toArrow()
        if some.num_rows:
            block = sc.broadcast((some["id"].to_numpy(), matrix(some["v"])))
            found.append(materialise(index.mapInArrow(searched(block), "query_id long, vec_id long, score double"), "found"))
            block.unpersist()
    out = functools.reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
