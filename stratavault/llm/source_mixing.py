"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes every document floor(r) times
and one more time with inclusion probability r - floor(r).  These fractional
probabilities are rounded by the cube method: a flight phase moves them inside
the null space of the balancing constraints (token total and document total of
the source) until at most two documents of a group are fractional, and a
landing phase settles those few.

Flights run over chunks of ``chunk`` documents each (a hash of doc_id and size
decides, and the number of a row among equal ones, so neither a hot source nor
many rows without a doc_id make a large chunk), longest documents first; what a
chunk leaves fractional, two documents at most, flies again with the leftovers
of up to ``chunk // 2`` other chunks.  One chunk of each source, the only one of
a small source, waits for these leftovers and flies and lands with them, so a
landing has about ``chunk`` documents to make up for a long one.

Defined results: a null text has size 0; a null source is a source of its own,
sorted last; a null doc_id is carried along; repeated rows are sampled one by
one; an empty table gives an empty result; columns other than doc_id, text and
source are not looked at.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, word_count

_EPS = 1e-9


def targets_of(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Sources (source, size, documents) with their rank by code point (null
    last), and their target: the water level times the weight, ``cap`` times the
    size at most.

    The table of sources is never collected.  Ranks are places within a range of
    sources plus the counts of the ranges before it; the level rises from one
    aggregate to the next until no more sources are full (sums are of integers,
    so reruns agree)."""
    ranged = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranged = materialize(ranged.withColumn("uid", F.monotonically_increasing_id()), "mix-ranged")
    ranged = ranged.withColumns({"range": F.shiftright("uid", 33), "nth": F.col("uid").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = ranged.join(starts, "range").select("source", "size", "documents", (F.col("start") + F.col("nth")).cast("int").alias("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = materialize(ranked.withColumn("weight", weight), "mix-ranked")
    total = ranked.agg(F.sum("size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap * F.col("size")
        count, held, open_ = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if count == full or not open_:
            break
        full, level = count, (share * total - cap * (held or 0)) / open_
    target = F.col("size") * cap if not open_ else F.least(F.col("size") * cap, F.lit(level) * F.col("weight"))
    return ranked.select("source", "rank", "documents", F.col("size").alias("source_size"), target.cast("double").alias("target"))


def water_fill(sizes: list[float], weights: list[float], budget: float, cap: float) -> list[float]:
    """Targets in proportion to ``weights`` that sum to ``budget``, none above
    ``cap`` times its size; what is cut off is shared again by weight.  For lists
    of sources; ``targets_of`` is the same for a table of them."""
    targets = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ -= full
    return targets


def flight(sizes: list[float], pi: list[float], rng: random.Random) -> list[float]:
    """Flight phase for the two constraints (sum of pi * size, sum of pi).

    Three fractional units span a null space of one dimension at least; a step
    along it, up or down with the probabilities that keep the expectation,
    makes one of them 0 or 1, and the next unit takes its place."""
    pi = list(pi)
    waiting = [i for i, p in enumerate(pi) if _EPS < p < 1 - _EPS]
    for i, p in enumerate(pi):
        if p <= _EPS or p >= 1 - _EPS:
            pi[i] = float(round(p))
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            step = (b - c, c - a, a - b)
            if not any(step):
                step = (1.0, -1.0, 0.0)
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            step = (1.0, -1.0)
        else:
            return pi
        up = down = math.inf
        for i, u in zip(active, step):
            if u > 0:
                up, down = min(up, (1 - pi[i]) / u), min(down, pi[i] / u)
            elif u < 0:
                up, down = min(up, pi[i] / -u), min(down, (1 - pi[i]) / -u)
        move = up if rng.random() * (up + down) < down else -down
        keep = []
        for i, u in zip(active, step):
            p = pi[i] + move * u
            if p <= _EPS or p >= 1 - _EPS:
                p = float(round(p))
            else:
                keep.append(i)
            pi[i] = p
        active = keep


def landing(sizes: list[float], pi: list[float]) -> list[float]:
    """Settle the few fractional units so that token and document totals end
    nearest to their expectation (ties: fewer units, then order)."""
    loose = [i for i, p in enumerate(pi) if 0 < p < 1]
    tokens = sum(pi[i] * sizes[i] for i in loose)
    count = sum(pi[i] for i in loose)
    best = min(
        range(1 << len(loose)),
        key=lambda bits: (
            abs(sum(sizes[i] for k, i in enumerate(loose) if bits >> k & 1) - tokens),
            abs(bits.bit_count() - count),
            bits,
        ),
    )
    out = list(pi)
    for k, i in enumerate(loose):
        out[i] = float(best >> k & 1)
    return near(sizes, out, sum(out[i] * sizes[i] for i in loose) - tokens)


def near(sizes: list[float], out: list[float], off: float) -> list[float]:
    """Bring a landed group that is ``off`` tokens over its target nearer to it:
    by the best flip of a single unit while one helps, else by the best exchange
    of a taken unit for another one, until neither helps."""
    size, taken = np.array(sizes, float), np.array(out) > 0.5
    while True:
        after = np.abs(off + np.where(taken, -size, size))
        k = int(after.argmin()) if len(after) else 0
        if len(after) and after[k] < abs(off) - _EPS:
            change = [k]
        else:
            ins, outs = np.flatnonzero(taken), np.flatnonzero(~taken)
            if not len(ins) or not len(outs):
                break
            outs = outs[np.argsort(size[outs], kind="stable")]
            want = size[ins] - off
            at = np.searchsorted(size[outs], want)
            pairs = [(ins, outs[np.clip(at + d, 0, len(outs) - 1)]) for d in (-1, 0)]
            best = min(((float(x[j]), int(i[j]), int(o[j])) for i, o in pairs for x in [np.abs(off - size[i] + size[o])] for j in [int(x.argmin())]))
            if best[0] >= abs(off) - _EPS:
                break
            change = [best[1], best[2]]
        for i in change:
            off += -size[i] if taken[i] else size[i]
            taken[i] = not taken[i]
    return taken.astype(float).tolist()


_FLOWN = "source string, rank int, chunk long, doc_id long, size long, pi double"


def _fly(seed: int, land: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("pi", "ascending")])
        sizes = [float(x) for x in group["size"].to_pylist()]
        rng = random.Random(f"{seed}/{group['rank'][0]}/{group['chunk'][0]}")
        pi = flight(sizes, group["pi"].to_pylist(), rng)
        if land:
            pi = landing(sizes, pi)
        return group.set_column(group.schema.get_field_index("pi"), "pi", pa.array(pi, pa.float64()))

    return run


def numbered(rows: DataFrame, each: int = 4096) -> DataFrame:
    """Each of ``equal`` equal rows, with its number ``turn`` among them."""
    parts = rows.withColumn("part", F.explode(F.expr(f"sequence(0, (equal - 1) div {each})")))
    turns = F.expr(f"sequence(part * {each}, least(equal, (part + 1) * {each}) - 1)")
    return parts.withColumn("turn", F.explode(turns)).drop("part", "equal")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    chunk: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken.

    Sources in code point order (null last) weigh ``weights`` in turn and share
    ``share`` times the corpus size; no target exceeds ``cap`` times its source.
    ``copies`` says how often the document is taken, ``taken`` is copies * size.
    The driver gets a few sums, nothing else.
    """
    # rows that are equal here are one row with a count, so that each gets a number that reruns agree on
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("equal")), "mix-sizes")
    sources = materialize(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("size"), F.sum("equal").alias("documents")), "mix-sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.least(F.floor(ratio + _EPS), F.lit(math.floor(cap))).cast("int")
    plan_df = targets_of(sources, weights, share, cap).withColumn("sure", sure).withColumn("part", F.greatest(F.lit(0.0), ratio - F.col("sure")))
    plan_df = plan_df.withColumn("part", F.when(F.col("part") > _EPS, F.col("part")).otherwise(0.0)).withColumn("chunks", F.ceil(F.col("documents") / chunk).cast("long"))
    plan_df = materialize(plan_df.drop("documents"), "mix-plan")
    sized = numbered(sized)
    joined = sized.alias("d").join(plan_df.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    parted = joined.where("part > 0")
    sure_only = joined.where("part <= 0").select("d.source", "rank", F.lit(0).cast("long").alias("chunk"), "doc_id", "size", F.lit(0.0).alias("pi"))
    start = parted.select(
        "d.source", "rank", F.expr("pmod(xxhash64(doc_id, size, turn), chunks)").alias("chunk"), "doc_id", "size", F.col("part").alias("pi")
    )
    done = sure_only
    held, flying = start.where("chunk = 0"), start.where("chunk > 0")
    groups = (plan_df.agg(F.max("chunks")).first()[0] or 1) - 1
    per = max(2, chunk // 2)
    while groups > 0:
        flown = materialize(flying.groupBy("rank", "chunk").applyInArrow(_fly(seed, False), _FLOWN), "mix-flight")
        done = done.unionByName(flown.where("pi in (0.0, 1.0)"))
        flying = flown.where("pi not in (0.0, 1.0)").withColumn("chunk", F.expr(f"(chunk - 1) div {per} + 1"))
        if groups <= per:
            held = held.unionByName(flying.withColumn("chunk", F.lit(0).cast("long")))
            break
        groups = -(-groups // per)
    done = done.unionByName(materialize(held.groupBy("rank", "chunk").applyInArrow(_fly(seed, True), _FLOWN), "mix-flight"))
    copies = (F.col("sure") + F.col("pi").cast("int")).cast("int")
    return (
        done.select("rank", "doc_id", "size", "pi")
        .join(plan_df.select("rank", "source", "source_size", "target", "sure"), "rank")
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: weights 5, 2, 1, 150 % of all sizes, cap 2."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
