"""Nearest neighbours by inner product with additive quantisation.

A vector is the sum of one codeword from each of ``books`` full-dimensional
codebooks.  Codebooks start as residual k-means and are refitted by least
squares on a bounded sample; every vector of the table is encoded by beam
search.  A sum of codewords is shorter than its vector, so the index stores,
besides the codes, the ratio of both norms; a query scores all codes of a block
through its lookup table of query-codeword products, times that ratio.  The
best ``rerank`` of each block are scored again on the original vectors in
double precision, and the blocks' best merge.

The sample's bound is the parameter ``train``; every row is indexed and every
query meets every block.  Data blocks hold codes and vectors together and move
once; what travels to them are the queries, in blocks of bounded size.

Defined results: see ``vectors.usable`` for rows that take no part; rows that
repeat a vec_id are candidates each, and queries each; vectors meet only those
of their own length; fewer than k candidates give all of them; ties go to the
smaller vec_id; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import blob
from .common import materialize, table
from .vectors import best_of_blocks, by_length, by_row, every_pair, matrix, meet, sample, usable


class Quantiser:
    """Codebooks of shape (books, words, dimensions)."""

    def __init__(self, books: np.ndarray):
        self.books = books

    def __reduce__(self):
        return Quantiser, (self.books,)  # products of codewords are made where they are needed

    @cached_property
    def gram(self) -> np.ndarray:
        """Products of all pairs of codewords."""
        m, k, d = self.books.shape
        flat = self.books.reshape(m * k, d)
        return (flat @ flat.T).reshape(m, k, m, k)

    @classmethod
    def train(cls, x: np.ndarray, books: int, words: int, rounds: int = 2, seed: int = 17) -> Quantiser:
        rng = np.random.default_rng(seed)
        rest, made = x.copy(), []
        for _ in range(books):
            centres = _k_means(rest, words, rng)
            rest = rest - centres[_nearest(rest, centres)]
            made.append(centres)
        self = cls(np.stack(made))
        for _ in range(rounds):
            self = self._refit(x, self.encode(x))
        return self

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> Quantiser:
        """Codebooks that minimise the squared error of given codes."""
        m, k, d = self.books.shape
        one = np.zeros((len(x), m * k), np.float32)
        for j in range(m):
            one[np.arange(len(x)), j * k + codes[:, j].astype(np.int64)] = 1
        normal = (one.T @ one).astype(np.float64) + 1e-2 * np.eye(m * k)
        target = one.T.astype(np.float64) @ x + 1e-2 * self.books.reshape(m * k, d)
        return Quantiser(np.linalg.solve(normal, target).reshape(m, k, d))

    def encode(self, x: np.ndarray, beam: int = 4, rows: int = 512) -> np.ndarray:
        """Beam search: partial sums keep the ``beam`` least squared errors."""
        m, k, _ = self.books.shape
        out = np.zeros((len(x), m), np.uint8)
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            n = len(part)
            dots = np.einsum("nd,mkd->mnk", part, self.books)
            codes = np.zeros((n, 1, 0), np.int64)
            error = np.zeros((n, 1))
            for j in range(m):
                norm = np.diagonal(self.gram[j, :, j, :])
                step = error[:, :, None] - 2 * dots[j][:, None, :] + norm[None, None, :]
                for i in range(j):
                    step = step + 2 * self.gram[i, :, j, :][codes[:, :, i]]
                flat = step.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(flat, best, 1)
                before, word = best // k, best % k
                codes = np.concatenate([np.take_along_axis(codes, before[:, :, None], 1), word[:, :, None]], 2)
            out[at : at + n] = codes[np.arange(n), error.argmin(1)]
        return out

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """Length of each reconstruction."""
        total = sum(self.books[j][codes[:, j]] for j in range(self.books.shape[0]))
        return np.sqrt((total**2).sum(1))

    def lookup(self, queries: np.ndarray) -> np.ndarray:
        return np.einsum("qd,mkd->mqk", queries, self.books).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        count = np.bincount(of, minlength=k)
        order = np.argsort(of, kind="stable")
        some = np.flatnonzero(count)
        first = np.cumsum(count)[some] - count[some]
        centres[some] = np.add.reduceat(x[order], first, axis=0) / count[some, None]
    return centres


_FOUND = "q_uid long, query_id long, uid long, vec_id long, score double"


def search(
    embeddings: DataFrame, queries: F.Column, k: int = 20, books: int = 24, words: int = 64, train: int = 4096, rerank: int = 256, query_block: int = 2048, data_block: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``queries`` (of
    vec_id) holds, against all other rows."""
    spark = embeddings.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for rows in by_length(usable(embeddings, zero=False)):
        found = _search(rows, queries, k, books, words, train, rerank, query_block, data_block)
        if found is not None:
            out = out.unionByName(found.select("query_id", "rank", "vec_id", "score"))
    return out


def _search(rows: DataFrame, queries: F.Column, k: int, books: int, words: int, train: int, rerank: int, query_block: int, data_block: int) -> DataFrame | None:
    spark = rows.sparkSession
    n_rows, n_asked = rows.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    if not n_asked:
        return None
    n_data, n_queries = -(-n_rows // data_block), -(-n_asked // query_block)
    quantiser = spark.sparkContext.broadcast(Quantiser.train(sample(rows, train), books, words))

    def ask(t: pa.Table) -> pa.Table:
        return pa.table({"qb": t["qb"].slice(0, 1), "q_uids": [blob(t["uid"].to_numpy())], "q_ids": [blob(t["vec_id"].to_numpy())], "queries": [blob(matrix(t["v"]))]})

    def encode(t: pa.Table) -> pa.Table:
        x = matrix(t["v"])
        codes = quantiser.value.encode(x)
        ratio = np.sqrt((x**2).sum(1)) / np.maximum(quantiser.value.norms(codes), 1e-300)
        return pa.table({"db": t["db"].slice(0, 1), "uids": [blob(t["uid"].to_numpy())], "ids": [blob(t["vec_id"].to_numpy())], "codes": [blob(codes)], "ratios": [blob(ratio)], "vectors": [blob(x)]})

    def score(row: dict) -> pa.RecordBatch:
        q_uids, q_ids = np.frombuffer(row["q_uids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
        uids, ids = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["ids"], "<i8")
        q = np.frombuffer(row["queries"], "<f8").reshape(len(q_ids), -1)
        x = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
        codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1).T.astype(np.int64)
        ratios = np.frombuffer(row["ratios"], "<f8").astype(np.float32)
        most = min(rerank, len(ids))
        parts: list[tuple] = []
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            near = np.zeros((len(ids), len(part)), np.float32)
            for table_, code in zip(quantiser.value.lookup(part), codes):
                near += np.ascontiguousarray(table_.T)[code]
            best = np.argpartition(np.ascontiguousarray((-near * ratios[:, None]).T), most - 1, axis=1)[:, :most]
            exact = np.einsum("qrd,qd->qr", x[best], part)
            own = uids[best] == q_uids[at : at + 64, None]
            order = np.lexsort((uids[best], ids[best], -exact, own), axis=1)[:, :k]
            best, exact, keep = (np.take_along_axis(v, order, 1) for v in (best, exact, ~own))
            of = np.repeat(np.arange(at, at + len(part)), keep.sum(1))
            parts.append((q_uids[of], q_ids[of], uids[best[keep]], ids[best[keep]], exact[keep]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=[x.split()[0] for x in _FOUND.split(", ")])

    asked = rows.where(queries).withColumn("qb", F.pmod(F.xxhash64("uid"), F.lit(n_queries)).cast("int"))
    asked = materialize(asked.groupBy("qb").applyInArrow(ask, "qb int, q_uids binary, q_ids binary, queries binary"), "aq-queries")
    index = rows.withColumn("db", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(n_data)).cast("int"))
    index = index.repartition(min(4 * n_data, 1 << 16), "db").groupBy("db")
    index = materialize(index.applyInArrow(encode, "db int, uids binary, ids binary, codes binary, ratios binary, vectors binary"), "aq-index")
    found = meet(every_pair(n_queries, n_data, spark), asked, index, n_data).mapInArrow(by_row(score), _FOUND)
    return best_of_blocks(found, k)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
