"""Operators on bytes: placement, gzip members and stitching, test bytes, ciphers."""

from __future__ import annotations

import hashlib
import hmac
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def test_bytes(spark: SparkSession, n: int) -> DataFrame:
    """``n`` deterministic bytes as blocks: 32 zero bytes, then each SHA-256 of
    the block before."""
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for count in batch.column(0).to_pylist():
                rows, block = [], bytes(32)
                for k in range(-(-count // 32)):
                    rows.append((k, block[: count - 32 * k].hex()))
                    block = hashlib.sha256(block).digest()
                yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int32()), "bytes": [r[1] for r in rows]})

    return spark.range(1).select(F.lit(n).alias("n")).mapInArrow(chain, "block int, bytes string")


class _Fit:
    """Lowest bin with enough room: a segment tree over the bins' room."""

    def __init__(self, cap: int):
        self.cap, self.size, self.tree, self.used = cap, 1, [0, 0], 0

    def put(self, need: int) -> tuple[int, int]:
        if self.tree[1] < need:
            if self.used == self.size:
                rooms = self.tree[self.size :] + [0] * self.size
                self.size *= 2
                self.tree = [0] * self.size + rooms
                for i in range(self.size - 1, 0, -1):
                    self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
            self._set(self.used, self.cap)
            self.used += 1
        i = 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] >= need else 2 * i + 1
        room = self.tree[i]
        self._set(i - self.size, room - need)
        return i - self.size, self.cap - room

    def _set(self, b: int, room: int) -> None:
        i = b + self.size
        self.tree[i] = room
        while i > 1:
            i //= 2
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])


def first_fit(objects: DataFrame, cap: int, shard: int | None = 50_000) -> DataFrame:
    """Placement in arrival order: an object that fits goes to the lowest silo
    with room, a larger one fills silos of its own and leaves its last one open.

    Placement is a fold; it runs for each shard of ``shard`` arrivals, and silo
    numbers are (shard, silo).  Without ``shard`` there is one fold over all
    arrivals, in one task."""
    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        fit, out = _Fit(cap), []
        for seq, length in zip(t["seq"].to_pylist(), t["length"].to_pylist()):
            if length <= cap:
                silo, at = fit.put(length)
                out.append((seq, 1, silo, at, length))
                continue
            part = 0
            while length > 0:
                part += 1
                fit_now = min(cap, length)
                silo, at = _fresh(fit, fit_now)
                out.append((seq, part, silo, at, fit_now))
                length -= fit_now
        columns = list(zip(*out))
        return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(out), pa.int64()), "seq": pa.array(columns[0], pa.int64()), "part": pa.array(columns[1], pa.int32()), "silo": pa.array(columns[2], pa.int32()), "offset": pa.array(columns[3], pa.int64()), "length": pa.array(columns[4], pa.int64())})

    rows = objects.select("seq", "length", (F.floor(F.col("seq") / shard) if shard else F.lit(0).cast("long")).alias("shard"))
    return rows.groupBy("shard").applyInArrow(fold, "shard long, seq long, part int, silo int, offset long, length long")


def _fresh(fit: _Fit, need: int) -> tuple[int, int]:
    """Open a new bin and fill it from its start."""
    if fit.used == fit.size:
        rooms = fit.tree[fit.size :] + [0] * fit.size
        fit.size *= 2
        fit.tree = [0] * fit.size + rooms
        for i in range(fit.size - 1, 0, -1):
            fit.tree[i] = max(fit.tree[2 * i], fit.tree[2 * i + 1])
    b = fit.used
    fit.used += 1
    fit._set(b, fit.cap - need)
    return b, 0


# --- gzip members with a length field -------------------------------------------------


def member(data: bytes, level: int = 9) -> bytes:
    """A gzip member whose extra field ``Aa`` holds its own total length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    deflated = packer.compress(data) + packer.flush(zlib.Z_SYNC_FLUSH) + packer.flush()
    total = 10 + 2 + 8 + len(deflated) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\x02\xff" + struct.pack("<H", 8) + b"Aa" + struct.pack("<HI", 4, total)
    return head + deflated + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def good_length(data: bytes) -> int | None:
    """The length that a member's field states; null if it has none."""
    if len(data) < 20 or data[:4] != b"\x1f\x8b\x08\x04" or data[12:14] != b"Aa" or data[8] not in (2, 4):
        return None
    return struct.unpack("<I", data[16:20])[0]


def stitched(members: list[bytes], bodies: list[bytes]) -> bytes:
    """Members as one: their deflate blocks one after another without the final
    empty block of each, then one final block and the joint checksum."""
    blocks = b"".join(m[20:-10] for m in members)
    crc, size = 0, 0
    for body in bodies:
        crc, size = zlib.crc32(body, crc), size + len(body)
    deflated = blocks + b"\x03\x00"
    head = b"\x1f\x8b\x08\x04\0\0\0\0\x02\xff" + struct.pack("<H", 8) + b"Aa" + struct.pack("<HI", 4, 28 + len(deflated))
    return head + deflated + struct.pack("<II", crc, size & 0xFFFFFFFF)


def gzip_roundtrip(rows: DataFrame) -> DataFrame:
    """Every payload through a member and back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for payload in batch.column(2).to_pylist():
                packed = member(payload)
                same.append(zlib.decompress(packed, 31) == payload and good_length(packed) == len(packed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], names=["id", "length", "same"])

    return rows.mapInArrow(run, "id string, length long, same boolean")


def stitch(parts: DataFrame) -> DataFrame:
    """Each segmented object as one gzip member made of its segments' members."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("number")
        bodies = t["body"].to_pylist()
        one = stitched([member(b) for b in bodies], bodies)
        reader = zlib.decompressobj(31)
        whole = reader.decompress(one)
        return pa.table({"id": t["id"].slice(0, 1), "digest": [hashlib.sha256(whole).hexdigest()], "single_member": [reader.eof and not reader.unused_data and good_length(one) == len(one)]})

    return parts.select("id", "number", "body").groupBy("id").applyInArrow(run, "id string, digest string, single_member boolean")


def counters(first: int, n: int) -> bytes:
    """``n`` counter blocks of 16 bytes, one after another, from ``first`` on."""
    high, low = divmod(first % (1 << 128), 1 << 64)
    out = np.empty((n, 2), ">u8")
    out[:, 1] = lows = np.uint64(low) + np.arange(n, dtype=np.uint64)
    out[:, 0] = np.uint64(high) + (lows < np.uint64(low)).astype(np.uint64)
    return out.tobytes()


def key_stream(blocks: Column, key: Column) -> Column:
    """Counter blocks encrypted, each by itself: what ECB does with them at once.
    The padding block at the end goes."""
    return F.call_function("substring", F.aes_encrypt(blocks, key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.octet_length(blocks))


def mixed(plain: bytes, stream: bytes) -> bytes:
    return (np.frombuffer(plain, np.uint8) ^ np.frombuffer(stream, np.uint8)[: len(plain)]).tobytes()


def encrypt_rows(rows: DataFrame, key: bytes, signing: bytes) -> DataFrame:
    """AES-256 in counter mode, the counter's start from an HMAC of the name.

    The key stream is Spark's own ``aes_encrypt`` in ECB mode over the counters;
    only the xor and the HMAC run in Python."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = int.from_bytes(hmac.new(signing, name.encode(), "sha256").digest()[:16])
                blocks.append(counters(first, -(-len(payload) // 16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.binary())], names=["id", "payload", "counters"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, payload, stream in zip(*(c.to_pylist() for c in batch.columns)):
                cipher = mixed(payload, stream)
                out.append((name, len(cipher), hashlib.sha256(cipher).hexdigest(), hmac.new(signing, cipher, "sha256").hexdigest()))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["id", "length", "sha256", "hmac"])

    counted = rows.mapInArrow(start, "id string, payload binary, counters binary")
    return counted.select("id", "payload", key_stream(F.col("counters"), F.lit(key)).alias("stream")).mapInArrow(finish, "id string, length long, sha256 string, hmac string")
