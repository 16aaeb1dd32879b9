"""Substring dedup by compacting a De Bruijn graph of word k-mers.

Every ``window`` consecutive words of a document are an edge of the graph.  A
word is removed if an edge that covers it also starts in a document with a
smaller doc_id.

1. Screen.  An edge that occurs twice has the same minimizer (its least hash
   of ``seed`` consecutive words) both times.  Minimizers, about a fourth as
   many as edges, meet by hash bucket; edges with a repeated one are kept.
2. Branches.  The kept edges meet by hash bucket.  Each learns whether it
   occurs again, and whether all its occurrences continue, and arrive, with the
   same word; the answers are joined back to the documents' edges.
3. Compaction.  In each document, runs of repeated edges without a branch
   between them become one path.  All edges of a path have the same
   occurrences, up to a shift, so a path stands or falls as a whole.
4. Verification.  Paths meet by a 128-bit digest of all their words; the path
   keeps its place in the document with the smallest id and is removed, by its
   source coordinates, from all others.

The screen and the branch test only propose: their 64-bit hashes can add or
cut paths, a keyed BLAKE2 digest of the path's words decides.

Spans are found by row, not by doc_id: each row with candidates gets a number
of its own (task and place in it), kept with its text.

A frequent edge costs a task one entry whatever its number of documents: tasks
collapse equal hashes before the exchange, and what they settle by themselves
is spread over other buckets.

Defined results: null text has no words; documents of fewer than ``window``
words lose nothing; rows with a null doc_id take no part and lose nothing;
rows that repeat a doc_id don't count against each other, and each loses what a
smaller doc_id has; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import blob, buckets_of, heads, joined, slices
from .common import bucket_count, materialize, table
from .words import buffers, gram_rows, grams, mix, pieces, split

_U = np.uint64
#: Entries that a task gathers before it sends them.
_FLUSH = 1_000_000
#: Words of kept edges in one block.
_BLOCK = 400_000


def _minimizers(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each start of a window, the least hash of its seeds."""
    g = grams(hashes, seed)
    span = window - seed + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, span):
        np.minimum(out, g[j : j + n], out=out)
    return out


def _send_minimizers(window: int, seed: int, buckets: int):
    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, d = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        at = heads(h, d)
        h, d = h[at], d[at]
        at = heads(h)
        first = np.zeros(len(h), bool)
        first[at] = True
        # the first document asks for its hash; the others know already that it is repeated
        repeated = np.repeat(np.diff(np.r_[at, len(h)]) > 1, np.diff(np.r_[at, len(h)]))
        b = np.where(first, buckets_of(h, buckets), (mix(d.astype(np.uint64)) % _U(buckets)).astype(np.int64))
        order = np.lexsort((~first, b))
        h, d, b, first, repeated = h[order], d[order], b[order], first[order], repeated[order]
        key = b * 2 + ~first
        cut = np.r_[heads(key), len(b)]
        return pa.RecordBatch.from_arrays(
            [pa.array(b[cut[:-1]].astype(np.int32)), pa.array(~first[cut[:-1]]), slices(h, cut), slices(d, cut), slices(repeated, cut)],
            names=["bucket", "sure", "hashes", "docs", "repeated"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in pieces(batch.column(1)):
                words = split(*buffers(batch.column(1).slice(a, b - a)))
                at, rows = gram_rows(words.first, window)
                m = _minimizers(words.hashes, window, seed)[at]
                keep = heads(m, rows)
                parts.append((m[keep], ids[a:b][rows[keep]]))
                n += len(keep)
                if n >= _FLUSH:
                    yield flush(parts)
                    parts, n = [], 0
        if n:
            yield flush(parts)

    return run


def _answer_minimizers(group: pa.Table) -> pa.Table:
    """Repeated minimizers of a bucket, gathered by document."""
    sure = group.filter(group["sure"])
    asked = group.filter(pc.invert(group["sure"]))
    h, d, r = joined(asked["hashes"], "<u8"), joined(asked["docs"], "<i8"), joined(asked["repeated"], "?")
    order = np.lexsort((d, h))
    h, d, r = h[order], d[order], r[order]
    at = heads(h)
    size = np.diff(np.r_[at, len(h)])
    hit = r.copy()
    if len(h):
        several = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at)
        hit |= np.repeat(several, size)
    h, d = np.r_[h[hit], joined(sure["hashes"], "<u8")], np.r_[d[hit], joined(sure["docs"], "<i8")]
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    at = heads(d)
    return pa.table({"d": pa.array(d[at]), "hashes": slices(h, np.r_[at, len(h)])})


_KEPT = "doc_id long, n_words long, kept_sha256 string, text string, row long, block long, docs binary, rows binary, starts binary, sizes binary, words binary"


def _keep_edges(window: int, seed: int):
    """Documents without candidates are done; those with some keep their text,
    and their runs of candidate edges go into blocks."""

    def block(parts: list[tuple], number: int) -> pa.RecordBatch:
        none = pa.array([None])
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([number], pa.int64())]
            + [pa.array([blob(np.concatenate(x))], pa.binary()) for x in zip(*parts)],
            names=_NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, n = [], 0
        next_row = next_block = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for a, b in pieces(batch.column(1)):
                text = batch.column(1).slice(a, b - a)
                part = ids.slice(a, b - a)
                words = split(*buffers(text))
                counts = words.counts()
                asked = batch.column(2).slice(a, b - a)
                known = [x for one in asked.to_pylist() if one for x in one]
                found = np.zeros(b - a, bool)
                number = np.zeros(b - a, "<i8")
                if known:
                    repeated = np.unique(np.frombuffer(b"".join(known), "<u8"))
                    at, rows = gram_rows(words.first, window)
                    m = _minimizers(words.hashes, window, seed)[at]
                    place = np.minimum(np.searchsorted(repeated, m), len(repeated) - 1)
                    hit = (repeated[place] == m) & np.asarray(part.is_valid())[rows]
                    at, rows = at[hit], rows[hit]
                    if len(at):
                        found[rows] = True
                        number = next_row + np.cumsum(found) - 1
                        next_row += int(found.sum())
                        new = np.r_[True, (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1])]
                        head = np.flatnonzero(new)
                        edges = np.diff(np.r_[head, len(at)])
                        size = edges + window - 1
                        begin = at[head]
                        pick = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        doc = part.fill_null(0).to_numpy(zero_copy_only=False)[rows[head]]
                        parts.append((doc.astype("<i8"), number[rows[head]].astype("<i8"), (begin - words.first[rows[head]]).astype("<i4"), size.astype("<i4"), words.hashes[pick]))
                        n += len(pick)
                raw = words.data.tobytes()
                digest = [None if f else hashlib.sha256(b" ".join(raw[s:e].split())).hexdigest() for f, s, e in zip(found.tolist(), words.text_first[:-1].tolist(), words.text_first[1:].tolist())]
                kept = text.take(pa.array(np.arange(b - a), mask=~found))
                null = pa.nulls(b - a, pa.binary())
                whole = [part, pa.array(counts), pa.array(digest, pa.string()), kept, pa.array(number, mask=~found), pa.nulls(b - a, pa.int64())]
                yield pa.RecordBatch.from_arrays(whole + [null] * 5, names=_NAMES)
                if n >= _BLOCK:
                    yield block(parts, next_block)
                    parts, n, next_block = [], 0, next_block + 1
        if n:
            yield block(parts, next_block)

    return run


_NAMES = [x.split()[0] for x in _KEPT.split(", ")]
_BRANCH = _U(2)


class _Block:
    """The candidate edges of a block: their hashes and neighbouring words."""

    def __init__(self, row: dict, window: int):
        self.docs, self.rows, self.starts = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["starts"], "<i4")
        self.sizes, self.words = np.frombuffer(row["sizes"], "<i4").astype(np.int64), np.frombuffer(row["words"], "<u8")
        first = np.r_[0, np.cumsum(self.sizes)]
        self.first = first
        self.at, self.run = gram_rows(first, window)
        self.hashes = grams(self.words, window)[self.at]
        tag = np.maximum(self.words, _U(3))
        last = self.at + window == first[self.run + 1]
        begin = self.at == first[self.run]
        self.next = np.where(last, _U(0), tag[np.minimum(self.at + window, len(tag) - 1)])
        self.prev = np.where(begin, _U(0), tag[np.maximum(self.at - 1, 0)])
        self.order = np.argsort(self.hashes, kind="stable")
        self.heads = heads(self.hashes[self.order])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, their neighbours (or a branch), repeated or not."""
        h = self.hashes[self.order]
        size = np.diff(np.r_[self.heads, len(h)])
        return h[self.heads], _agree(self.next[self.order], self.heads), _agree(self.prev[self.order], self.heads), size > 1


def _agree(tags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tag that a run has in common, or the mark of a branch."""
    if not len(at):
        return tags[:0]
    low, high = np.minimum.reduceat(tags, at), np.maximum.reduceat(tags, at)
    return np.where(low == high, low, _BRANCH)


def _send_edges(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, after, before, several = _Block(row, window).distinct()
                b = buckets_of(h, buckets)
                order = np.argsort(b, kind="stable")
                cut = np.r_[heads(b[order]), len(b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[order][cut[:-1]].astype(np.int32)), pa.array([row["block"]] * (len(cut) - 1), pa.int64())] + [slices(x[order], cut) for x in (h, after, before, several)],
                    names=["bucket", "block", "hashes", "after", "before", "several"],
                )

    return run


def _answer_edges(group: pa.Table) -> pa.Table:
    """For each edge sent: bit 0 it is repeated, 1 it branches behind, 2 before."""
    blocks = group["block"].to_pylist()
    sizes = [len(x) // 8 for x in group["hashes"].to_pylist()]
    h, several = joined(group["hashes"], "<u8"), joined(group["several"], "?")
    after, before = joined(group["after"], "<u8"), joined(group["before"], "<u8")
    order = np.argsort(h, kind="stable")
    at = heads(h[order])
    size = np.diff(np.r_[at, len(h)])
    again = (size > 1) | np.logical_or.reduceat(several[order], at)
    right, left = _agree(after[order], at) == _BRANCH, _agree(before[order], at) == _BRANCH
    flags = np.zeros(len(h), np.uint8)
    flags[order] = np.repeat(again.astype(np.uint8) | right.astype(np.uint8) << 1 | left.astype(np.uint8) << 2, size)
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": group["bucket"].combine_chunks(), "flags": slices(flags, np.r_[0, np.cumsum(sizes)])})


_PATH = "digest binary, size int, doc_id long, row long, start int"


def _paths(window: int, buckets: int):
    """Repeated edges without a branch between them, as paths."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = dict(zip(right["bucket"].to_pylist(), right["flags"].to_pylist()))
        for row in left.to_pylist():
            block = _Block(row, window)
            h = block.hashes[block.order][block.heads]
            b = buckets_of(h, buckets)
            order = np.argsort(b, kind="stable")
            distinct = np.zeros(len(h), np.uint8)
            distinct[order] = np.frombuffer(b"".join(answers[x] for x in np.unique(b).tolist()), np.uint8)
            flags = np.zeros(len(block.hashes), np.uint8)
            flags[block.order] = np.repeat(distinct, np.diff(np.r_[block.heads, len(block.hashes)]))
            keep = np.flatnonzero(flags & 1)
            if not len(keep):
                continue
            at, rn, f = block.at[keep], block.run[keep], flags[keep]
            new = np.r_[True, (at[1:] != at[:-1] + 1) | (rn[1:] != rn[:-1]) | (f[:-1] & 2 > 0) | (f[1:] & 4 > 0)]
            head = np.flatnonzero(new)
            size = np.diff(np.r_[head, len(at)]) + window - 1
            begin = at[head]
            words = block.words.astype("<u8").view(np.uint8)
            digest = [hashlib.blake2b(words[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(begin.tolist(), (begin + size).tolist())]
            where = rn[head]
            out.append((digest, size.astype(np.int32), block.docs[where], block.rows[where], (block.starts[where] + (begin - block.first[where])).astype(np.int32)))
        digests = pa.array([d for x in out for d in x[0]], pa.binary())
        columns = [np.concatenate(x) for x in list(zip(*out))[1:]] if out else [np.zeros(0, t) for t in ("i4", "i8", "i8", "i4")]
        return pa.table({n.split()[0]: c for n, c in zip(_PATH.split(", "), [digests, *map(pa.array, columns)])})

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode().split()
            gone = np.zeros(n + 1, np.int64)
            for s in spans or ():
                gone[s["start"]] += 1
                gone[s["start"] + s["size"]] -= 1
            stay = np.cumsum(gone[:-1]) == 0
            kept = [w for w, k in zip(words, stay.tolist()) if k]
            rows.append((doc, n, n - len(kept), b" ".join(kept).decode()))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 13, seed: int = 6) -> tuple[DataFrame, DataFrame]:
    """What repeated spans leave of each document.

    Returns two tables: rows of documents that have no candidate span
    (doc_id, n_words, kept_sha256 of the words joined by one space), and rows of
    all others (doc_id, n_words, n_removed, kept: the text that is left)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    buckets = bucket_count(docs, 1 << 21)
    asked = docs.where("doc_id is not null").mapInArrow(_send_minimizers(window, seed, buckets), "bucket int, sure boolean, hashes binary, docs binary, repeated binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer_minimizers, "d long, hashes binary")
    answers = answers.groupBy("d").agg(F.collect_list("hashes").alias("hashes"))
    joined_docs = docs.join(answers, docs.doc_id == answers.d, "left").select("doc_id", "text", "hashes")
    kept = materialize(joined_docs.mapInArrow(_keep_edges(window, seed), _KEPT), "dedup-edges")
    blocks = kept.where("block is not null").select("block", "docs", "rows", "starts", "sizes", "words")
    sent = blocks.mapInArrow(_send_edges(window, buckets), "bucket int, block long, hashes binary, after binary, before binary, several binary")
    flags = sent.groupBy("bucket").applyInArrow(_answer_edges, "block long, bucket int, flags binary")
    paths = materialize(blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_paths(window, buckets), _PATH), "dedup-paths")
    # written first: a join right on top of the aggregate couldn't split a frequent path
    owners = materialize(paths.groupBy("digest", "size").agg(F.min("doc_id").alias("owner")), "dedup-owners")
    spans = paths.join(owners, ["digest", "size"]).where("doc_id > owner")
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    texts = kept.where("text is not null").select("row", "doc_id", "n_words", "text")
    cut = texts.join(spans, "row", "left").select("doc_id", "n_words", "text", "spans")
    whole = kept.where("block is null and text is null").select("doc_id", "n_words", "kept_sha256")
    return whole, cut.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of those kept."""
    whole, cut = remove_repeats(table(spark, sf_dir, "documents"))
    whole = whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.unionByName(cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


OP10_SQL = r"""
with w as (
  select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), g as (
  select row, doc_id, unnest(range(1, len(ws) - 11)) as i, ws from w where len(ws) >= 13
), k as (
  select row, doc_id, i, md5(array_to_string(list_slice(ws, i, i + 12), ' ')) as h from g
), m as (
  select h, min(doc_id) as first_doc from k group by h
), r as (
  select distinct k.row, unnest(range(k.i, k.i + 13)) as p from k join m using (h) where m.first_doc < k.doc_id
), rr as (select row, list(p) as ps from r group by row)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(case when ps is null then array_to_string(ws, ' ')
    else array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(ps, i)), lambda i: ws[i]), ' ') end) as kept_sha256
from w left join rr using (row)
"""
