"""Packing documents into training sequences by a grouping genetic algorithm.

Documents are tokenised, closed with an end token and, only if longer than a
sequence, cut into pieces: the first piece takes the remainder, all others are
full.  Full pieces are sequences of their own; all other pieces go to groups of
about ``group`` pieces.  Each group is packed by several islands, each with a
population of its own.  A crossover injects whole well-filled sequences of one
parent into the other, drops the duplicates by dissolving the sequences they
were in, and puts the displaced pieces back by best fit.  After each epoch
every island sends its elite to the next one.  Sequences that the best island
of a group leaves with room to spare are opened again, and their pieces are
dealt anew to groups of the same size, until a level saves less than one
sequence a group or one group is left.  A group never grows beyond about
``group`` pieces.

Only ids of pieces and their lengths move between tasks; token ids never do:
a piece's checksum is taken where it is tokenised.

Tokenising works on units that byte-level BPE treats independently: a single
space between two non-space characters always begins a new pre-token, so the
text between such spaces is encoded once and kept in a bounded table of its
worker.  The added tokens of the vocabulary's JSON file, ``<|endoftext|>``, are
one id each wherever they stand in a text, as ``tokenizers`` encodes them.

Defined results: a null or empty text is its end token alone; a null doc_id is
carried along; repeated rows are packed one by one; an empty table gives an
empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .words import pieces as row_ranges

#: Units that a worker's table holds at most before it starts afresh.
_KNOWN = 300_000
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]|  | \n|\n |^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path() -> str:
    """The public byte-level vocabulary, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(dict):
    """Units seen so far, without their leading space, and their ids as bytes."""

    def __init__(self, path: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.parts = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")

    def plain(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= _KNOWN:
            self.clear()
        ids = self.plain(" " + unit)
        if len(unit) <= 64:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, unsigned 32-bit in machine order."""
        if any(t in text for t in self.added):  # an added token is its id, and the texts around it are texts of their own
            return b"".join([self.added.get(part) or self.encode(part) for part in self.parts.split(text) if part])
        units = _CUT.split(text) if _OTHER_SPACE.search(text) else text.split(" ")
        return self.plain(units[0]) + b"".join([self[u] for u in units[1:]])


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, most: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), array("I", [end_id]).tobytes()
        for batch in batches:
            for a, b in row_ranges(batch.column(1), 1 << 21):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                    ids = (encoder.encode(text) if text else b"") + end
                    n = len(ids) // 4
                    start, k = 0, 0
                    while start < n:
                        length = (n % most or most) if k == 0 else most
                        rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, k = start + length, k + 1
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECE)


def best_fit(lengths: list[int], order: list[int], assign: list[int], free: dict[int, int], cap: int) -> None:
    """Put the items ``order`` into the fullest bin with room, or a new one.

    Bins stand in a list for each amount of room; the bits of one integer say
    which lists have bins, so the best fit is its lowest set bit."""
    rooms: list[list[int]] = [[] for _ in range(cap + 1)]
    mask = 0
    for b, f in free.items():
        rooms[f].append(b)
        mask |= 1 << f
    fresh = max(free, default=-1) + 1
    for i in order:
        need = lengths[i]
        fits = mask >> need
        if fits:
            f = need + (fits & -fits).bit_length() - 1
            b = rooms[f].pop()
            if not rooms[f]:
                mask ^= 1 << f
        else:
            b, f = fresh, cap
            fresh += 1
        assign[i] = b
        rooms[f - need].append(b)
        mask |= 1 << (f - need)
        free[b] = f - need


def _fill(lengths: np.ndarray, assign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered from 0 without gaps, and what each holds."""
    _, assign = np.unique(assign, return_inverse=True)
    return assign, np.bincount(assign, lengths).astype(np.int64)


def _cost(lengths: np.ndarray, assign: np.ndarray, cap: int) -> tuple[int, float]:
    """Fewer bins first, then bins of uneven fill (their squares sum higher)."""
    _, fill = _fill(lengths, assign)
    return len(fill), -float(((fill / cap) ** 2).sum())


def _cross(lengths: np.ndarray, base: np.ndarray, donor: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of ``donor`` into ``base``."""
    base, base_fill = _fill(lengths, base)
    donor, fill = _fill(lengths, donor)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 3), replace=False)] = True
    injected = chosen[donor]
    hit = np.zeros(len(base_fill), bool)
    hit[base[injected]] = True
    worst = np.argsort(base_fill, kind="stable")[: max(1, len(base_fill) // 50)]
    hit[worst] = True  # a small mutation: the emptiest bins open as well
    loose = np.flatnonzero(hit[base] & ~injected)
    child = np.where(injected, donor + len(base_fill), base)
    kept = np.flatnonzero(~hit)
    free = {int(b): int(cap - base_fill[b]) for b in kept}
    free.update({int(b) + len(base_fill): int(cap - fill[b]) for b in np.flatnonzero(chosen)})
    out = child.tolist()
    order = loose[np.argsort(-lengths[loose], kind="stable")].tolist()
    best_fit(lengths.tolist(), order, out, free, cap)
    return np.asarray(out, np.int64)


def evolve(lengths: np.ndarray, population: list[np.ndarray], cap: int, generations: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A population, best first; starts from best fit over noisy orders."""
    n = len(lengths)
    least = -(-int(lengths.sum()) // cap)
    scored = [(_cost(lengths, p, cap), p) for p in population]
    while len(scored) < size:
        noise = 0.0 if not scored else 0.15 * rng.random()
        order = np.argsort(-lengths * (1 + noise * rng.standard_normal(n)), kind="stable").tolist()
        assign = [0] * n
        best_fit(lengths.tolist(), order, assign, {}, cap)
        one = np.asarray(assign, np.int64)
        scored.append((_cost(lengths, one, cap), one))
        if scored[-1][0][0] <= least:
            break
    scored.sort(key=lambda x: x[0])
    for _ in range(generations):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        a, b = sorted(rng.choice(len(scored), 2, replace=False))
        child = _cross(lengths, scored[a][1], scored[b][1], cap, rng)
        scored.append((_cost(lengths, child, cap), child))
        scored.sort(key=lambda x: x[0])
        del scored[size:]
    return [p for _, p in scored]


_ISLAND = "grp long, island int, ids binary, lengths binary, population array<binary>"


def _settle(cap: int, islands: int):
    """Items of a group become one row an island."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        ids = group["uid"].to_numpy().astype("<i8").tobytes()
        lengths = group["length"].to_numpy().astype("<i4").tobytes()
        g = group["grp"][0].as_py()
        return pa.table({"grp": pa.array([g] * islands, pa.int64()), "island": pa.array(range(islands), pa.int32()), "ids": pa.array([ids] * islands, pa.binary()), "lengths": pa.array([lengths] * islands, pa.binary()), "population": pa.array([[]] * islands, pa.list_(pa.binary()))})

    return run


def _epoch(cap: int, generations: int, size: int, islands: int, seed: int, epoch: int):
    """Evolve each island, then send its elite on to the next."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("island").to_pylist()
        lengths = np.frombuffer(rows[0]["lengths"], "<i4").astype(np.int64)
        g, island = rows[0]["grp"], rows[0]["island"]
        start = [np.frombuffer(p, "<i4").astype(np.int64) for r in rows for p in r["population"]]
        rng = np.random.default_rng([seed, epoch, g, island])
        people = [p.astype("<i4").tobytes() for p in evolve(lengths, start, cap, generations, size, rng)]
        to = [(island, people)] + ([((island + 1) % islands, people[:1])] if islands > 1 else [])
        return pa.table({"grp": pa.array([g] * len(to), pa.int64()), "island": pa.array([i for i, _ in to], pa.int32()), "ids": pa.array([rows[0]["ids"]] * len(to), pa.binary()), "lengths": pa.array([rows[0]["lengths"]] * len(to), pa.binary()), "population": pa.array([p for _, p in to], pa.list_(pa.binary()))})

    return run


_PLACED = "uid long, length long, sequence_id long, offset long, open boolean"


def _best(cap: int, level: int, slack: int):
    """The best packing of a group; bins with more than ``slack`` room stay open."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("island").to_pylist()
        ids = np.frombuffer(rows[0]["ids"], "<i8")
        lengths = np.frombuffer(rows[0]["lengths"], "<i4").astype(np.int64)
        people = [np.frombuffer(p, "<i4").astype(np.int64) for r in rows for p in r["population"]]
        best, fill = _fill(lengths, min(people, key=lambda p: _cost(lengths, p, cap)))
        order = np.argsort(best, kind="stable")
        run_sum = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
        offset = run_sum - np.repeat(run_sum[first], np.diff(np.r_[first, len(order)]))
        base = ((level + 1) << 56) + (int(rows[0]["grp"]) << 24)
        return pa.table({"uid": ids[order], "length": lengths[order], "sequence_id": base + best[order], "offset": offset, "open": fill[best[order]] < cap - slack})

    return run


def pack(pieces: DataFrame, cap: int = 1024, group: int = 4096, islands: int = 3, size: int = 4, generations: int = 6, epochs: int = 2, slack: int = 4, seed: int = 5) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` up to ``cap``."""
    pieces = materialize(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pack-pieces")
    items = pieces.select(F.col("__uid").alias("uid"), F.col("length").cast("long").alias("length"))
    full = items.where(F.col("length") >= cap).select("uid", (F.lit(-1) - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.where(F.col("length") < cap)
    placed, level, before = full, 0, None
    groups = max(1, -(-left.count() // group))
    while True:
        left = left.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        world = left.groupBy("grp").applyInArrow(_settle(cap, islands), _ISLAND)
        for epoch in range(epochs):
            world = materialize(world.groupBy("grp", "island").applyInArrow(_epoch(cap, generations, size, islands, seed + level, epoch), _ISLAND), "pack-islands")
        done = materialize(world.groupBy("grp").applyInArrow(_best(cap, level, slack), _PLACED), "pack-level")
        counts = done.agg(F.count_if(F.col("offset") == 0), F.count_if("open"), F.count_if(F.col("open") & (F.col("offset") == 0))).first()
        # bins of this level against the bins its pieces were in before
        if groups == 1 or not counts[1] or before is not None and before - counts[0] < groups:
            placed = placed.unionByName(done.select("uid", "sequence_id", "offset"))
            return pieces.join(placed, F.col("uid") == F.col("__uid")).drop("uid", "__uid")
        placed = placed.unionByName(done.where("not open").select("uid", "sequence_id", "offset"))
        left, level, before = done.where("open").select("uid", "length"), level + 1, counts[2]
        groups = -(-counts[1] // group)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(cut_pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
