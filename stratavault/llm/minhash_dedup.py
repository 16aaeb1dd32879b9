"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``tables`` sub-keys each are computed for a document, every
sub-key from ``rows`` minhashes.  A table key combines one sub-key of either
collection, so tables**2 keys of 2 * rows minhashes need only 2 * tables * rows
minhashes.  Two documents of similarity s miss each other with probability
1 - (1 - (1 - s**rows)**tables)**2: with 3 rows and 16 tables 2.1e-5 at 0.8,
5e-7 at 0.85 and less above.

1. Documents with the same shingle set collapse to one representative.
2. Representatives meet by hash bucket of their first sub-keys; a task expands
   the products only among those that share one.  In each key group every
   member is paired with the smallest member.
3. Candidates are confirmed on their full shingle sets; links give components.
4. Keys whose members lie in several components hold these together as a
   family.  Within a family, shingles are put in one order, those of its first
   member (what most members share) last; two sets as similar as asked have a
   shingle in common among the first ``n - ceil(n * percent / 100) + 1`` of
   each.  Members that share no such shingle with another component are done;
   the others meet in pairs of bounded blocks, where exact bounds on sizes and on
   shingle counts by bin leave few pairs across components to confirm.  So every
   link between documents that share a key counts, with no cap on groups.

Before an exchange, a task collapses members of the same key to the smallest
one it has, so a group of near copies costs a task one entry a key.

Shingles: texts are lower-cased (A-Z), words split at ASCII white space, and
``shingle`` consecutive words form a shingle; fewer words form one shingle.

Defined results: null texts and texts without words have an empty set, link
with nothing and are kept; a row with a null doc_id takes no part (its
component is null) and is kept; rows that repeat a doc_id count as linked; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import blob, buckets_of, heads, joined, slices
from .common import bucket_count, materialize, table
from .components import components
from .words import buffers, gram_rows, grams, mix, pieces, split

_U = np.uint64


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the place
    of each text's first (one more entry than texts)."""
    words = split(*buffers(column), lower=True)
    at, rows = gram_rows(words.first, width)
    h = grams(words.hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short.tolist()):
            for x in words.hashes[words.first[i] : words.first[i + 1]]:
                whole[k : k + 1] = mix(whole[k : k + 1] * _U(0xC2B2AE3D27D4EB4F) + x)
        h, rows = np.r_[h, whole], np.r_[rows, short]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = heads(h, rows)
    h, rows = h[keep], rows[keep]
    return h, np.searchsorted(rows, np.arange(len(counts) + 1))


class Banding:
    """The minhashes and sub-keys of both collections."""

    def __init__(self, rows: int, tables: int, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = 2 * rows * tables
        self.rows, self.tables = rows, tables
        self.xors = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.factors = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)

    def keys(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First sub-keys (64 bits) and second ones (32 bits) of non-empty sets."""
        x = (h >> _U(32)).astype(np.uint32)
        at = first[:-1]
        out = np.zeros((2 * self.tables, len(at)), np.uint64)
        for t in range(2 * self.tables):
            key = np.full(len(at), t, np.uint64)
            for r in range(self.rows):
                j = t * self.rows + r
                low = np.minimum.reduceat((x ^ self.xors[j]) * self.factors[j], at)
                key = mix(key * _U(0x9E3779B97F4A7C15) + low)
            out[t] = key
        return out[: self.tables].T, (out[self.tables :].T & _U(0xFFFFFFFF)).astype(np.uint32)


_SIGNED = "doc_id long, n long, s1 long, s2 long, a array<long>, b array<int>"


def _sign(width: int, banding: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = banding.tables
        for batch in batches:
            for lo, hi in pieces(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(lo, hi - lo)
                h, first = shingle_sets(batch.column(1).slice(lo, hi - lo), width)
                n = np.diff(first)
                some = np.flatnonzero(n > 0)
                sums = np.zeros((2, hi - lo), np.uint64)
                lengths = np.zeros(hi - lo + 1, np.int32)
                lengths[1:][some] = m
                a, b = np.zeros((0, m), np.uint64), np.zeros((0, m), np.uint32)
                if len(some):
                    at = first[:-1][some]
                    for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D)):
                        sums[k, some] = np.add.reduceat(mix(h ^ _U(salt)), at)
                    a, b = banding.keys(h, np.r_[at, len(h)])
                places = pa.array(np.cumsum(lengths), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums)]
                    + [pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(a).view(np.int64).ravel())), pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(b).view(np.int32).ravel()))],
                    names=["doc_id", "n", "s1", "s2", "a", "b"],
                )

    return run


class _Entries:
    """First sub-keys with what belongs to them, of some documents."""

    def __init__(self, key, doc, n, comp, second, mask):
        self.key, self.doc, self.n, self.comp, self.second, self.mask = key, doc, n, comp, second, mask

    def collide(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products of entries that share their first sub-key, sorted by key,
        component and document: the entry, the table and the key of each."""
        order = np.argsort(self.key, kind="stable")
        at = heads(self.key[order])
        size = np.diff(np.r_[at, len(order)])
        chosen = order[np.repeat(size > 1, size)]
        e, j = np.nonzero(self.mask[chosen])
        e = chosen[e]
        product = mix(self.key[e] ^ mix(self.second[e, j].astype(np.uint64) | j.astype(np.uint64) << _U(32)))
        order = np.lexsort((self.doc[e], self.comp[e], product))
        return e[order], j[order], product[order]


def _send_keys(tables: int, buckets: int, pairs: bool):
    """Entries to the bucket of their first sub-key; without those whose every
    key the task has already with a smaller member of the same component."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, n, comp, a, b = (np.concatenate(x) for x in zip(*parts))
        m = tables
        x = _Entries(a.ravel(), np.repeat(doc, m), np.repeat(n, m), np.repeat(comp, m), np.repeat(b, m, 0), np.ones((len(doc) * m, m), bool))
        e, j, key = x.collide()
        at = heads(key, x.comp[e])
        lead = np.repeat(e[at], np.diff(np.r_[at, len(e)]))
        rest = np.ones(len(e), bool)
        rest[at] = False
        x.mask[e[rest], j[rest]] = False
        if pairs and rest.any():
            one, two = x.doc[lead[rest]], x.doc[e[rest]]
            n1, n2 = x.n[lead[rest]], x.n[e[rest]]
            order = np.lexsort((two, one))
            order = order[heads(one[order], two[order])]
            bucket = (mix(one[order].astype(np.uint64) ^ mix(two[order].astype(np.uint64))) % _U(buckets)).astype(np.int64)
            order = order[np.argsort(bucket, kind="stable")]
            cut = np.r_[heads(np.sort(bucket)), len(bucket)]
            yield row(np.sort(bucket)[cut[:-1]], True, cut, two[order].view(np.uint64), one[order], n2[order], n1[order], np.zeros((len(order), 0), np.uint32), np.zeros((len(order), 0), np.uint8))
        keep = np.flatnonzero(x.mask.any(1))
        bucket = buckets_of(x.key[keep], buckets)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        cut = np.r_[heads(bucket), len(bucket)]
        yield row(bucket[cut[:-1]], False, cut, x.key[keep], x.doc[keep], x.n[keep], x.comp[keep] if not pairs else x.comp[:0], x.second[keep], np.packbits(x.mask[keep], 1))

    def row(bucket, sure, cut, key, doc, n, comp, second, mask) -> pa.RecordBatch:
        def wide(values: np.ndarray) -> pa.Array:
            each = values.shape[1] * values.itemsize
            return slices(np.frombuffer(blob(values), np.uint8), cut * each)

        comp = slices(comp, cut) if len(comp) else pa.nulls(len(bucket), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket.astype(np.int32)), pa.array([sure] * len(bucket)), slices(key, cut), slices(doc, cut), slices(n, cut), comp, wide(second), wide(mask)], names=_SENT_NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                a = part.column(3).flatten().to_numpy().view(np.uint64).reshape(-1, tables)
                b = part.column(4).flatten().to_numpy().view(np.uint32).reshape(-1, tables)
                parts.append((part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), a, b))
                count += part.num_rows
                if count >= 8192:
                    yield from flush(parts)
                    parts, count = [], 0
        if count:
            yield from flush(parts)

    return run


_SENT = "bucket int, sure boolean, keys binary, docs binary, ns binary, comps binary, seconds binary, masks binary"
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _entries(group: pa.Table, tables: int) -> _Entries:
    key, doc = joined(group["keys"], "<u8"), joined(group["docs"], "<i8")
    comp = joined(group["comps"], "<i8")
    second = joined(group["seconds"], "<u4").reshape(-1, tables)
    mask = np.unpackbits(joined(group["masks"], "u1").reshape(len(key), -(-tables // 8)), axis=1)[:, :tables].astype(bool)
    return _Entries(key, doc, joined(group["ns"], "<i8"), comp if len(comp) else np.zeros(len(key), np.int64), second, mask)


_PAIR = "a long, b long, na long, nb long"


def _pair_up(tables: int):
    """In each key group of a bucket, the smallest member with every other."""

    def run(group: pa.Table) -> pa.Table:
        sure = group.filter(group["sure"])
        x = _entries(group.filter(pc.invert(group["sure"])), tables)
        e, _, key = x.collide()
        at = heads(key)
        lead = np.repeat(e[at], np.diff(np.r_[at, len(e)]))
        one, two = np.r_[x.doc[lead], joined(sure["docs"], "<i8")], np.r_[x.doc[e], joined(sure["keys"], "<i8")]
        n1, n2 = np.r_[x.n[lead], joined(sure["comps"], "<i8")], np.r_[x.n[e], joined(sure["ns"], "<i8")]
        order = np.lexsort((two, one))
        order = order[heads(one[order], two[order])]
        order = order[one[order] != two[order]]
        return pa.table({"a": one[order], "b": two[order], "na": n1[order], "nb": n2[order]})

    return run


def _mixed(tables: int):
    """In each key group of a bucket whose members lie in several components,
    the smallest component with every other."""

    def run(group: pa.Table) -> pa.Table:
        x = _entries(group, tables)
        e, _, key = x.collide()
        at = heads(key)
        size = np.diff(np.r_[at, len(e)])
        comp = x.comp[e]
        one, two = np.repeat(comp[at], size), comp
        keep = np.flatnonzero(one != two)
        order = keep[np.lexsort((two[keep], one[keep]))]
        order = order[heads(one[order], two[order])]
        return pa.table({"a": one[order], "b": two[order]})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(1), 1 << 20):
                h, first = shingle_sets(batch.column(1).slice(lo, hi - lo), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), slices(h, first)], names=["id", "shingles"])

    return run


def first_shingles(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a sorted set that come first in its family's order, as
    many as a set of that similarity can't all lack."""
    rest = np.isin(s, common, assume_unique=True)
    most = len(s) - (percent * len(s) + 99) // 100 + 1
    return np.r_[s[~rest], s[rest]][:most]


def _first(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_shingles(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column(3), batch.column(4))]
            of = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(h.view(np.int64))], names=["family", "rep", "component", "h"])

    return run


def _pack_block(t: pa.Table) -> pa.Table:
    """The members of a block in one row."""
    sets = t["shingles"].to_pylist()
    first = np.r_[0, np.cumsum([len(x) // 8 for x in sets])]
    return pa.table({"family": t["family"].slice(0, 1), "x": t["block"].slice(0, 1), "blocks": t["blocks"].slice(0, 1), "ids": [blob(t["rep"].to_numpy())], "comps": [blob(t["component"].to_numpy())], "first": [blob(first)], "sets": [b"".join(sets)]})


_BINS = 512


def _cross_blocks(percent: int):
    """Links between two blocks of a family.

    A pair is left out if its members are in one component already, or if their
    counts of shingles by bin show that they can't reach the similarity: what two
    sets share in a bin is at most the smaller of both counts."""

    def members(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        ids, comps = np.frombuffer(row[f"ids_{side}"], "<i8"), np.frombuffer(row[f"comps_{side}"], "<i8")
        first, data = np.frombuffer(row[f"first_{side}"], "<i8"), np.frombuffer(row[f"sets_{side}"], "<u8")
        sets = [data[a:b] for a, b in zip(first[:-1], first[1:])]
        return ids, comps, sets, np.stack([np.bincount((x >> _U(40)).astype(np.int64) % _BINS, minlength=_BINS) for x in sets]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids_x, comps_x, sets_x, bins_x = members(row, "x")
                ids_y, comps_y, sets_y, bins_y = members(row, "y")
                size_y = bins_y.sum(1)
                above: dict[int, int] = {}

                def top(c: int) -> int:
                    while c in above:
                        c = above[c]
                    return c

                found = []
                for i in range(len(ids_x)):
                    n = len(sets_x[i])
                    fit = np.flatnonzero((comps_y != comps_x[i]) & (100 * np.minimum(n, size_y) >= percent * np.maximum(n, size_y)))
                    if not len(fit):
                        continue
                    most = np.minimum(bins_x[i], bins_y[fit]).sum(1)
                    for j in fit[100 * most >= percent * (n + size_y[fit] - most)].tolist():
                        p, q = top(int(comps_x[i])), top(int(comps_y[j]))
                        if p == q:
                            continue
                        both = np.concatenate([sets_x[i], sets_y[j]])
                        both.sort()
                        same = int((both[1:] == both[:-1]).sum())
                        if 100 * same >= percent * (len(both) - same):
                            above[max(p, q)] = min(p, q)
                            found.append((ids_x[i], ids_y[j]))
                a, b = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 3, tables: int = 16, block: int = 256) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Links join documents whose shingle sets have a Jaccard similarity of
    ``percent`` / 100 or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    buckets = bucket_count(docs, 1 << 21)
    signed = materialize(docs.mapInArrow(_sign(shingle, Banding(rows, tables)), _SIGNED), "near-signed")
    real = signed.where("doc_id is not null and n > 0")
    reps = materialize(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "near-reps")
    keyed = real.alias("s").join(reps.alias("r"), (F.col("s.doc_id") == F.col("r.rep")) & (F.col("s.s1") == F.col("r.s1")) & (F.col("s.s2") == F.col("r.s2")))
    keyed = materialize(keyed.select("rep", "s.n", "a", "b"), "near-keys")
    zero = F.lit(0).cast("long")
    sent = keyed.select("rep", "n", zero.alias("component"), "a", "b").mapInArrow(_send_keys(tables, buckets, True), _SENT)
    pairs = materialize(sent.groupBy("bucket").applyInArrow(_pair_up(tables), _PAIR).distinct(), "near-pairs")
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-ids")
    sets = docs.join(ids, docs.doc_id == ids.id, "left_semi").mapInArrow(_sets(shingle), "id long, shingles binary")
    sets = materialize(sets, "near-sets")

    def confirmed(found: DataFrame) -> DataFrame:
        fit = found.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
        two = fit.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        both = two.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        return both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")

    links = materialize(confirmed(pairs), "near-links")
    named = materialize(components(links), "near-components")
    again = keyed.join(named, keyed.rep == named.node, "left").select("rep", "n", F.coalesce("component", "rep").alias("component"), "a", "b")
    again = materialize(again, "near-again")
    mixed = again.mapInArrow(_send_keys(tables, buckets, False), _SENT).groupBy("bucket").applyInArrow(_mixed(tables), "a long, b long")
    mixed = materialize(mixed, "near-mixed")
    if mixed.take(1):
        # families: components that keys hold together; their members meet in pairs of blocks
        family = components(mixed).select(F.col("node").alias("component"), F.col("component").alias("family"))
        inside = materialize(again.select("rep", "component").join(family, "component"), "near-inside")
        of = sets.dropDuplicates(["id"])
        lead = inside.groupBy("family").agg(F.min("rep").alias("id")).join(of, "id").select("family", F.col("shingles").alias("common"))
        whole = inside.join(of, F.col("rep") == F.col("id")).join(materialize(lead, "near-leads"), "family").select("family", "rep", "component", "shingles", "common")
        firsts = materialize(whole.mapInArrow(_first(percent), "family long, rep long, component long, h long"), "near-firsts")
        met = firsts.groupBy("family", "h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("family", "h")
        met = firsts.join(materialize(met, "near-shared"), ["family", "h"], "left_semi").select("rep").distinct()
        inside = materialize(inside.join(met, "rep", "left_semi"), "near-met")
        sizes = materialize(inside.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "near-sizes")
        dealt = inside.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.join(sets.dropDuplicates(["id"]), F.col("rep") == F.col("id")).select("family", "block", "blocks", "rep", "component", "shingles")
        packed = dealt.groupBy("family", "block").applyInArrow(_pack_block, "family long, x int, blocks int, ids binary, comps binary, first binary, sets binary")
        packed = materialize(packed, "near-blocks")
        wide = ["ids", "comps", "first", "sets"]
        left = packed.select("family", "x", F.explode(F.expr("sequence(x, blocks - 1)")).alias("y"), *[F.col(c).alias(f"{c}_x") for c in wide])
        right = packed.select("family", F.explode(F.expr("sequence(0, x)")).alias("z"), F.col("x").alias("y"), *[F.col(c).alias(f"{c}_y") for c in wide]).withColumnRenamed("z", "x")
        more = materialize(left.join(right, ["family", "x", "y"]).mapInArrow(_cross_blocks(percent), "a long, b long"), "near-more")
        if more.take(1):
            stars = named.select(F.col("node").alias("a"), F.col("component").alias("b"))
            named = materialize(components(stars.union(more)), "near-components")
    classes = reps.join(named, reps.rep == named.node, "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    classes = materialize(classes, "near-classes")
    out = signed.alias("s").join(classes.alias("c"), (F.col("s.s1") == F.col("c.s1")) & (F.col("s.s2") == F.col("c.s2")) & (F.col("s.n") == F.col("c.n")) & F.col("s.doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("s.n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates among all documents, on 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


OP3_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as ss from w
), n as (select doc_id, cast(len(ss) as bigint) as n from s
), g as (select doc_id, unnest(ss) as h from s
), c as (select a.doc_id as x, b.doc_id as y, count(*) as both_n from g a join g b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2
), l as (
  select x, y from c join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 100 * both_n >= 80 * (nx.n + ny.n - both_n)
), e as (select x, y from l union all select y, x from l
), r(doc_id, reach) as (
  select doc_id, doc_id from n
  union
  select e.y, r.reach from r join e on r.doc_id = e.x where r.reach < e.y
)
select n.doc_id, n.n as n_shingles, min(reach) as component_id, n.doc_id = min(reach) as kept from n join r using (doc_id) group by n.doc_id, n.n
"""
