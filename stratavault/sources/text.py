"""Line and frame sources: id lists, manifests, wire frames, the cursor cache."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import files

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pos, line) of the non-empty lines of text files, in the files' order.

    Positions are counts within a split plus those of the splits before it."""
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part")]
    parts = None
    for k, path in enumerate(paths):
        one = spark.read.text(path).select(F.lit(k).alias("file"), *meta, F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "\r$", "").alias("line"))
        parts = one if parts is None else parts.unionByName(one)
    keys = ["file", "path", "part"]
    counts = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1
    placed = parts.withColumn("within", within).join(counts.select(*keys, before.alias("before")), keys)
    return placed.where("line <> ''").select((F.col("before") + F.col("within")).alias("pos"), "line")


def assemble(value: F.Column) -> F.Column:
    """Lines of a text that ends them with CR, LF or both."""
    return F.filter(F.split(value, "[\r\n]"), lambda x: x != "")


def id_list(spark: SparkSession, paths: list[str], size: int = X.ID_SIZE, prefix: str = X.PREFIX) -> DataFrame:
    """(pos, line, id) of files with one id a line, perhaps with the prefix and
    with text behind it.  A short or non-hexadecimal id is an error."""
    bare = F.when(F.lower(F.substring("line", 1, len(prefix))) == prefix.lower(), F.substr("line", F.lit(len(prefix) + 1))).otherwise(F.col("line"))
    rows = lines(spark, paths).withColumn("bare", bare).withColumn("id", F.substring("bare", 1, size))
    wrong = F.when(F.length("bare") < size, F.concat(F.lit('ID too short: "'), "line", F.lit('"'))).when(~F.col("id").rlike("^[0-9a-fA-F]*$"), F.concat(F.lit('Non-hex characters in id: "'), "line", F.lit('"')))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.lower("id"))
    return rows.select("pos", "line", checked.alias("id"))


# --- manifests ----------------------------------------------------------------------------


def parse_manifest(text: str) -> Iterator[tuple[str, str, str]]:
    """(folder, file, digest) of the files of a directory manifest.

    ``/set type=`` changes the default, a ``dir`` entry is entered until ``..``,
    kinds other than file and dir and empty files are left out, and a backslash
    at a line's end joins the next one."""
    folders: list[str] = []
    default = "file"
    for line in re.sub(r"\\\r?\n", "  ", text).splitlines():
        words = line.split()
        if not words:
            continue
        name, fields = words[0], dict(w.partition("=")[::2] for w in words[1:])
        kind = fields.get("type", default)
        if name == "/set":
            default = kind if kind in ("dir", "file") else default
        elif name == "..":
            if folders:
                folders.pop()
        elif kind == "dir":
            folders.append(name)
        elif kind == "file" and fields.get("sha256digest", EMPTY) != EMPTY:
            yield "/".join(folders), name, fields["sha256digest"]


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(target, pos, dirname, filename, digest) of manifest files; a file is one
    fold, as each line depends on those before it.  Names are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(target, i, *r) for i, r in enumerate(parse_manifest(content.decode("utf-8", "surrogateescape")))]
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["target", "pos", "dirname", "filename", "digest"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    found = raw.mapInArrow(run, "target string, pos long, dirname string, filename string, digest string")
    return found.withColumns({"dirname": X.unvis(F.col("dirname")), "filename": X.unvis(F.col("filename"))})


def listing(spark: SparkSession, folder: str, exclude: str | None = None) -> DataFrame:
    """A manifest made from the files below a folder, named as they lie in it;
    empty ones and those whose path in the folder matches ``exclude`` are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    top = files.split(folder)[1].rstrip("/") + "/"
    inner = F.substr("path", F.instr("path", F.lit(top)) + F.lit(len(top)))
    rows = rows.withColumn("inner", inner)
    rows = rows if exclude is None else rows.where(~F.col("inner").rlike(exclude))
    return rows.select(F.lit(folder).alias("target"), F.regexp_replace("inner", "/?[^/]*$", "").alias("dirname"), F.regexp_extract("inner", "[^/]*$", 0).alias("filename"), F.sha2("content", 256).alias("digest"))


# --- frames -------------------------------------------------------------------------------


def parse_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(command, payload) of the frames in a byte stream.

    A frame's first byte holds the command in its low three bits and the size's
    kind in its upper two: nothing, 32 bytes, one length byte, four of them."""
    at = 0
    while at < len(data):
        head, at = data[at], at + 1
        kind, size = head >> 6, 0
        if kind == 1:
            size = 32
        elif kind:
            width = 1 if kind == 2 else 4
            if at + width > len(data):
                raise ValueError("the stream ends in a frame's length")
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            raise ValueError("the stream ends in a frame")
        yield head & 7, data[at : at + size]
        at += size


def frames(streams: DataFrame) -> DataFrame:
    """(stream, content) to (stream, seq, cmd, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(parse_frames(data or b""))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([c for c, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["stream", "seq", "cmd", "payload"])

    return streams.select(F.col("stream").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "stream string, seq long, cmd int, payload binary")


def frame(cmd: F.Column, payload: F.Column) -> F.Column:
    """One frame's bytes."""
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    kind = F.when(size == 0, 0).when(size == 32, 1).when(size < 256, 2).otherwise(3)
    head = F.lpad(F.hex((cmd + 64 * kind).cast("long")), 2, "0")
    width = F.when(kind == 2, F.lpad(F.hex(size.cast("long")), 2, "0")).when(kind == 3, F.lpad(F.hex(size.cast("long")), 8, "0")).otherwise("")
    return F.concat(F.unhex(F.concat(head, width)), F.coalesce(payload, F.lit(b"")))


# --- cache --------------------------------------------------------------------------------


def read_cache(path: str) -> tuple[int, int]:
    """The two cursors; zeros where the file is missing or short."""
    if not files.exists(path):
        return 0, 0
    system, inner = files.split(path)
    with system.open_input_stream(inner, compression=None) as file:
        data = file.read()
    return struct.unpack("<II", data[:8]) if len(data) >= 8 else (0, 0)


def write_cache(path: str, first: int, second: int) -> None:
    system, inner = files.split(path)
    with system.open_output_stream(inner, compression=None) as file:
        file.write(struct.pack("<II", first, second))
