"""Incremental backup of silos: selection, encryption in counter mode, side files.

A file is encrypted in chunks, each by a task of its own at its place in the key
stream; the chunks then pass in order through one task a file, which writes them
and the digests.  No task holds more than a chunk."""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .archive import backup_select
from .bytes_ops import counters, key_stream, mixed
from .physical import clustered

_LEDGER = "fn string, last_tm double, last_sz long"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(fn, path, size) of the silos below a folder."""
    found = [(os.path.basename(p), p, n) for p, n, _ in files.listed(folder, ".warc.gz")]
    return spark.createDataFrame(found, "fn string, path string, size long")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """What was saved when: lines of name, time and size."""
    if not files.exists(path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).option("sep", " ").csv(path)


def encrypt(rows: DataFrame, secrets: Callable[[str], tuple[bytes, bytes]], chunk: int = 1 << 20) -> DataFrame:
    """(fn, path, size) to (fn, at, cipher), a row a chunk.

    The key stream is Spark's ``aes_encrypt`` over a chunk's counters together;
    the first counter is an HMAC of the name without ``.bin``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fn, path, at in zip(*(c.to_pylist() for c in batch.columns)):
                key, signing = secrets(fn)
                system, inner = files.split(path)
                with system.open_input_file(inner) as file:
                    file.seek(at)
                    plain = file.read(chunk)
                first = int.from_bytes(hmac.new(signing, fn.replace(".bin", "").encode(), "sha256").digest()[:16], "big") + at // 16
                blocks = counters(first, -(-len(plain) // 16))
                yield pa.RecordBatch.from_arrays([pa.array([fn]), pa.array([at]), pa.array([plain], pa.binary()), pa.array([key], pa.binary()), pa.array([blocks], pa.binary())], names=["fn", "at", "plain", "key", "counters"])

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cipher = mixed(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([cipher], pa.binary())], names=["fn", "at", "cipher"])

    parts = rows.select("fn", "path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk))).alias("at"))
    # some bytes a row, but a chunk's work: left alone, all would go to one task
    parts = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fn", "at")
    read_ = parts.mapInArrow(read, "fn string, at long, plain binary, key binary, counters binary")
    return read_.select("fn", "at", "plain", key_stream(F.col("counters"), F.col("key")).alias("stream")).mapInArrow(mix, "fn string, at long, cipher binary")


def write(ciphers: DataFrame, out: str, secrets: Callable[[str], tuple[bytes, bytes]]) -> DataFrame:
    """Write each file's chunks in order below ``out`` with ``.hmac`` and
    ``.sha256`` beside it; (fn, length, sha256, hmac)."""

    def put(path: str, data: bytes) -> None:
        system, inner = files.split(path)
        with system.open_output_stream(inner, compression=None) as file:
            file.write(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, sha, mac, length = None, None, None, None, 0

        def close() -> pa.RecordBatch:
            file.close()
            put(f"{out}/{now}.hmac", (mac.hexdigest() + "\n").encode())
            put(f"{out}/{now}.sha256", f"SHA256 ({now}) = {sha.hexdigest()}\n".encode())
            return pa.RecordBatch.from_pydict({"fn": [now], "length": pa.array([length], pa.int64()), "sha256": [sha.hexdigest()], "hmac": [mac.hexdigest()]})

        for batch in batches:
            for fn, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if fn != now:
                    if file is not None:
                        yield close()
                    system, inner = files.split(f"{out}/{fn}")
                    now, file, sha, mac, length = fn, system.open_output_stream(inner, compression=None), hashlib.sha256(), hmac.new(secrets(fn)[1], digestmod="sha256"), 0
                file.write(part)
                sha.update(part)
                mac.update(part)
                length += len(part)
        if file is not None:
            yield close()

    return clustered(ciphers, "fn", "at").mapInArrow(run, "fn string, length long, sha256 string, hmac string")


def backup(spark: SparkSession, folder: str, out: str, ledger: str, quota: int, now: float, secrets: Callable[[str], tuple[bytes, bytes]]) -> DataFrame:
    """Save what has changed, up to ``quota`` bytes, below ``out``: files go to
    ``out.staging`` first, which then takes the place of ``out``; the ledger is
    rewritten last."""
    current, past = scan(spark, folder), read_ledger(spark, ledger)
    chosen = backup_select(current.select("fn", "size"), past, quota, now)
    staging = f"{out.rstrip('/')}.staging"
    system, inner = files.split(staging)
    if files.exists(staging):
        system.delete_dir(inner)
    system.create_dir(inner, recursive=True)
    done = write(encrypt(current.join(chosen.select("fn"), "fn", "left_semi"), secrets), staging, secrets).toPandas()  # a row a file saved, bounded by the quota
    _, target = files.split(out)
    if files.exists(out):
        system.delete_dir(target)
    system.move(inner, target)
    saved = spark.createDataFrame(done, "fn string, length long, sha256 string, hmac string") if len(done) else spark.createDataFrame([], "fn string, length long, sha256 string, hmac string")
    kept = past.join(saved, "fn", "left_anti").unionByName(saved.select("fn", F.lit(now).alias("last_tm"), F.col("length").alias("last_sz")))
    rows = sorted(tuple(r) for r in kept.collect())  # a row a silo
    system, inner = files.split(ledger)
    with system.open_output_stream(f"{inner}.new", compression=None) as file:
        file.write("".join(f"{fn} {tm} {sz}\n" for fn, tm, sz in rows).encode())
    system.move(f"{inner}.new", inner)
    return saved
