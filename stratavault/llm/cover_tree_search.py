"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors are rounded to integers first, and scores are exact integers.  Queries
and data are dealt to blocks around pivots (a bounded sample, farthest first),
and each block indexes its points once in a cover tree, which is stored with
the block.  Two trees are searched together: for a pair of nodes no product
exceeds

    <a, b> + |a| s + |b| r + r s

with centres a, b and covering radii r, s, and the pair is pruned if that is
below the worst kth score of the query node's points.

Each query block first meets the data blocks of its own pivot.  The kth scores
found there prune pairs of whole blocks by the same bound, on rows that hold a
centre and a radius a block; only blocks that are left meet, and the kth scores
go with them.

Vectors whose products could exceed 62 bits (square sum beyond 2**62) form
blocks of their own; their products are taken in unbounded integers, without a
bound, and a top score that doesn't fit a long raises an error.

Defined results: see ``vectors.usable`` for rows that take no part (zero
vectors do); rows that repeat a vec_id are candidates each, and queries each;
vectors meet only those of their own length; fewer than k candidates give all
of them; ties go to the smaller vec_id; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import blob
from .common import materialize, table
from .vectors import best_of_blocks, by_length, by_row, every_pair, matrix, meet, sample, usable

_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max
#: Products below this are exact in doubles.
_EXACT = 2.0**52
#: Square sums up to this keep products, and their partial sums, in a long.
_NARROW = 2.0**62


class CoverTree:
    """A cover tree of points by nested nets.

    Centres are points in farthest-first order, so the centres up to any place
    are apart by at least the distance at which the next one was added, and
    cover all points within it.  A level's centres are those added at
    ``gaps[1] / base**level`` or more: every level holds the centres above it
    (nesting), each point lies within the level's distance of one (covering),
    and no two are nearer than that (separation).  A centre's parent is itself
    or its nearest centre one level up; nodes with one child are that child.

    ``nodes`` are (first, last, centre, radius, children) over the points in
    tree order, the radius being the greatest distance that occurs."""

    def __init__(self, points: np.ndarray, leaf: int = 64, base: float = 1.3):
        x = points.astype(np.float64)
        most = -(-len(x) // leaf)
        self.centres, self.gaps = [0], [np.inf]
        far, of = ((x - x[0]) ** 2).sum(1), np.zeros(len(x), np.int64)
        while len(self.centres) < most and far.max() > 0:
            k = int(far.argmax())
            self.gaps.append(float(np.sqrt(far[k])))
            d = ((x - x[k]) ** 2).sum(1)
            of[d < far] = len(self.centres)
            far = np.minimum(far, d)
            self.centres.append(k)
        self.levels, limit = [1], self.gaps[1] if len(self.gaps) > 1 else 0.0
        while self.levels[-1] < len(self.centres):
            size = int(np.searchsorted(-np.array(self.gaps), -limit, "right"))
            if size > self.levels[-1]:
                self.levels.append(size)
            limit /= base
        centre = x[self.centres]
        below: dict[int, list] = {k: [] for k in range(len(centre))}  # nodes as (centre, children), leaves first
        for upper, size in zip(self.levels[-2::-1], self.levels[:0:-1]):
            groups: dict[int, list[int]] = {k: [k] for k in range(upper)}
            for k in range(upper, size):
                groups[int(((centre[:upper] - centre[k]) ** 2).sum(1).argmin())].append(k)
            below = {k: [(m, below[m]) for m in members] if len(members) > 1 else below[k] for k, members in groups.items()}
        self.nodes: list[tuple[int, int, np.ndarray, float, list[int]]] = []
        self.order = np.zeros(len(x), np.int64)
        members = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[members], np.arange(len(centre) + 1))

        def place(k: int, children: list, first: int) -> int:
            number, own = len(self.nodes), []
            self.nodes.append(())
            last = first
            for child, inner in children:
                own.append(place(child, inner, last))
                last = self.nodes[own[-1]][1]
            if not children:
                rows = members[begin[k] : begin[k + 1]]
                last = first + len(rows)
                self.order[first:last] = rows
            radius = float(np.sqrt(((x[self.order[first:last]] - centre[k]) ** 2).sum(1).max()))
            self.nodes[number] = (first, last, centre[k], radius, own)
            return number

        place(0, below[0], 0)


class Block:
    """Points of a block in tree order, with their ids and their tree."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        self.wide = bool(((points**2).sum(1) > _NARROW).any())
        tree = None if self.wide else CoverTree(points)
        order = tree.order if tree else np.arange(len(points))
        self.nodes = tree.nodes if tree else [(0, len(points), np.zeros(points.shape[1]), np.inf, [])]
        points = points[order]
        if not self.wide:  # as narrow as the values allow
            most = np.abs(points).max(initial=0)
            points = points.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
        self.values, self.ids, self.uids = points, ids[order], uids[order]

    def products(self, other: Block, lo: int, hi: int, first: int, last: int) -> np.ndarray:
        """Products of own points lo to hi with those of the other block, as longs;
        beyond a long they are its ends."""
        a, b = self.values[lo:hi], other.values[first:last]
        if self.wide or other.wide:
            exact = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
            return np.array([[max(_NONE + 1, min(_LAST, v)) for v in r] for r in exact], np.int64).reshape(hi - lo, last - first)
        x, y = a.astype(np.float64), b.astype(np.float64)
        if float((x**2).sum(1).max()) * float((y**2).sum(1).max()) < _EXACT**2:
            return (x @ y.T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T


class TopK:
    """The k best so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _NONE, np.int64)
        self.vec = np.full((n, k), _LAST, np.int64)
        self.row = np.full((n, k), -1, np.int64)  # places in the data block

    def add(self, lo: int, hi: int, scores: np.ndarray, ids: np.ndarray, first: int) -> None:
        k = self.score.shape[1]
        some = (scores >= self.score[lo:hi, -1:]) & (scores != _NONE)
        column = np.flatnonzero(some.any(0))
        if not len(column):
            return
        s = np.concatenate([self.score[lo:hi], np.where(some[:, column], scores[:, column], _NONE)], 1)
        v = np.concatenate([self.vec[lo:hi], np.where(some[:, column], ids[column], _LAST)], 1)
        r = np.concatenate([self.row[lo:hi], np.where(some[:, column], first + column, -1)], 1)
        order = np.lexsort((r, v, r < 0, ~s), axis=1)[:, :k]
        self.score[lo:hi], self.vec[lo:hi], self.row[lo:hi] = (np.take_along_axis(x, order, 1) for x in (s, v, r))


def most(a: np.ndarray, r: float, b: np.ndarray, s: float) -> float:
    """The greatest product of points within r of a and s of b, with room for
    rounding in proportion to all that was added up."""
    size = float(np.linalg.norm(a)), float(np.linalg.norm(b))
    reach = size[0] * s + size[1] * r + r * s
    return float(a @ b) + reach + 1e-9 * (size[0] * size[1] + reach) + 1e-6


def dual_search(queries: Block, data: Block, top: TopK, floors: np.ndarray | None = None) -> int:
    """Search both trees together; the number of point pairs that were scored.

    ``floors``: scores that a result has to reach, for each query."""
    done = 0
    free = queries.wide or data.wide
    least = np.full(len(queries.ids), _NONE, np.int64) if floors is None else floors

    def bound(q: int, d: int) -> float:
        return np.inf if free else most(queries.nodes[q][2], queries.nodes[q][3], data.nodes[d][2], data.nodes[d][3])

    stack = [(0, 0, bound(0, 0))]
    while stack:
        q, d, value = stack.pop()
        lo, hi, _, _, q_below = queries.nodes[q]
        if value < int(np.maximum(top.score[lo:hi, -1], least[lo:hi]).min()):
            continue
        first, last, _, _, d_below = data.nodes[d]
        if not q_below and not d_below:
            scores = queries.products(data, lo, hi, first, last)
            scores[(queries.uids[lo:hi, None] == data.uids[None, first:last]) | (scores < least[lo:hi, None])] = _NONE
            top.add(lo, hi, scores, data.ids[first:last], first)
            done += scores.size
            continue
        pairs = [(a, b, bound(a, b)) for a in (q_below or [q]) for b in (d_below or [d])]
        stack += sorted(pairs, key=lambda x: x[2])
    return done


_FOUND = "qb int, q_uid long, query_id long, uid long, vec_id long, score long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _pack(number: str):
    """The points of a block as one row: block, tree, and what bounds it."""

    def run(t: pa.Table) -> pa.Table:
        block = Block(matrix(t["v"]), t["vec_id"].to_numpy(), t["uid"].to_numpy())
        _, _, centre, radius, _ = block.nodes[0]
        return pa.table({number: t[number].slice(0, 1), "pivot": t["pivot"].slice(0, 1), "centre": [blob(centre)], "radius": [radius], "block": [pickle.dumps(block)]})

    return run


def search(embeddings: DataFrame, queries: F.Column, k: int = 5, scale: int = 256, pivots: int = 16, sampled: int = 2048, query_block: int = 2048, data_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``queries`` (of
    vec_id) holds, against all other rows; components are floor(scale * x)."""
    out = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for rows in by_length(usable(embeddings, zero=True)):
        found = _search(rows, queries, k, scale, pivots, sampled, query_block, data_block)
        if found is not None:
            whole = F.when((F.col("score") == _LAST) | (F.col("score") == _NONE + 1), F.raise_error(F.lit("a product doesn't fit a long")).cast("long")).otherwise(F.col("score"))
            out = out.unionByName(found.select("query_id", "rank", "vec_id", whole.alias("score")))
    return out


def _search(rows: DataFrame, queries: F.Column, k: int, scale: int, pivots: int, sampled: int, query_block: int, data_block: int) -> DataFrame | None:
    spark = rows.sparkSession
    some = np.floor(scale * sample(rows, sampled))
    some = some[(some**2).sum(1) <= _NARROW]
    some = some if len(some) else np.zeros((1, some.shape[1]))
    chosen = [0]
    far = ((some - some[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(some)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((some - some[chosen[-1]]) ** 2).sum(1))
    centres = some[chosen]

    def nearest(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.floor(scale * matrix(part.column(2)))
                of = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
                of[(x**2).sum(1) > _NARROW] = len(centres)  # a pivot number of their own
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), v, pa.array(of.astype(np.int32))], names=["uid", "vec_id", "v", "pivot"])

    dealt = materialize(rows.mapInArrow(nearest, "uid long, vec_id long, v array<double>, pivot int"), "cover-points")

    def numbered(part: DataFrame, size: int, salt: int, name: str) -> tuple[DataFrame, int]:
        """Block numbers from 0: each pivot has as many blocks as its count asks for."""
        counts = {r["pivot"]: r["count"] for r in part.groupBy("pivot").count().collect()}
        first, base, many = 0, F.lit(0), F.lit(1)
        for p in sorted(counts):  # as many entries as pivots
            n = -(-counts[p] // size)
            base, many = F.when(F.col("pivot") == p, F.lit(first)).otherwise(base), F.when(F.col("pivot") == p, F.lit(n)).otherwise(many)
            first += n
        return part.withColumn(name, (base + F.pmod(F.xxhash64("uid", F.lit(salt)), many)).cast("int")), first

    asked, n_queries = numbered(dealt.where(queries), query_block, 1, "qb")
    known, n_data = numbered(dealt, data_block, 2, "db")
    if not n_queries:
        return None
    kind = "int, pivot int, centre binary, radius double, block binary"
    asked = materialize(asked.groupBy("qb").applyInArrow(_pack("qb"), f"qb {kind}"), "cover-queries")
    known = known.repartition(min(4 * n_data, 1 << 16), "db").groupBy("db")
    known = materialize(known.applyInArrow(_pack("db"), f"db {kind}"), "cover-data")

    def compare(row: dict) -> pa.RecordBatch:
        q, d = pickle.loads(row["q_block"]), pickle.loads(row["block"])
        top, floors = TopK(len(q.ids), k), None
        if row.get("floor"):
            low = dict(zip(row["floor_uids"], row["floor"]))
            floors = np.array([low.get(i, _NONE) for i in q.uids.tolist()], np.int64)
        dual_search(q, d, top, floors)
        at, place = np.nonzero(top.row >= 0)
        row_of = top.row[at, place]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["qb"], np.int32)), *map(pa.array, (q.uids[at], q.ids[at], d.uids[row_of], d.ids[row_of], top.score[at, place]))], names=_NAMES)

    near = asked.select("qb", "pivot").join(known.select("db", "pivot"), "pivot").select("qb", "db")
    home = meet(near, asked.select("qb", F.col("block").alias("q_block")), known.select("db", "block"), n_data).mapInArrow(by_row(compare), _FOUND)
    home = materialize(best_of_blocks(home, k), "cover-home")

    # kth scores of all queries of a block; null where one has fewer than k results
    kth = home.where(F.col("rank") == k).groupBy("qb").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.collect_list("q_uid").alias("floor_uids"), F.collect_list("score").alias("floor"))
    sizes = numbered(dealt.where(queries), query_block, 1, "qb")[0].groupBy("qb").agg(F.count(F.lit(1)).alias("size"))
    kth = materialize(sizes.join(kth, "qb", "left").select("qb", F.when(F.col("n") == F.col("size"), F.col("least")).alias("least"), "floor_uids", "floor"), "cover-floors")
    bounds = asked.select("qb", F.col("pivot").alias("q_pivot"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius")).join(kth.select("qb", "least"), "qb")

    chunk = 1024
    packed = known.select(F.floor(F.col("db") / chunk).cast("int").alias("chunk"), "db", "pivot", "centre", "radius").groupBy("chunk").agg(F.collect_list(F.struct("db", "pivot", "centre", "radius")).alias("known"))

    def prune(row: dict) -> pa.RecordBatch:
        a, r = np.frombuffer(row["q_centre"], "<f8"), row["q_radius"]
        left = []
        for d in row["known"]:
            if d["pivot"] == row["q_pivot"]:
                continue
            value = most(a, r, np.frombuffer(d["centre"], "<f8"), d["radius"]) if np.isfinite(r) and np.isfinite(d["radius"]) else np.inf
            if row["least"] is None or value >= row["least"]:
                left.append(d["db"])
        return pa.RecordBatch.from_arrays([pa.array([row["qb"]] * len(left), pa.int32()), pa.array(left, pa.int32())], names=["qb", "db"])

    chunks = every_pair(n_queries, -(-n_data // chunk), spark).withColumnRenamed("db", "chunk")
    rest = materialize(chunks.join(bounds, "qb").join(packed, "chunk").mapInArrow(by_row(prune), "qb int, db int"), "cover-pairs")
    asked = asked.join(kth, "qb", "left").select("qb", F.col("block").alias("q_block"), "floor_uids", "floor")
    far_found = meet(rest, asked, known.select("db", "block"), n_data).mapInArrow(by_row(compare), _FOUND)
    return best_of_blocks(home.drop("rank").unionByName(far_found), k)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of every fiftieth vector with all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.row, c.row as c_row, q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.row <> c.row and len(q.e) = len(c.e) and len(q.e) > 0 and c.vec_id is not null
), r as (select *, cast(row_number() over (partition by row order by score desc, vec_id, c_row) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
