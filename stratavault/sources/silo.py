"""Silo files (``*.warc.gz``) as a data source: ``format("silo")``.

A record is three gzip members: header (with its own length in an extra field),
body, and the record's end.  Reading options:

``body``     ``true`` to decompress bodies; off, they are skipped by their stated length
``raw``      ``true`` to return the body's gzip member as it is
``lenient``  walk members that lack the length field
``offset``   where to begin in a file (a record's start)
``silo``     numbers, comma-separated: only these silos

A folder with level folders (``0/``, ``1/``, ...) is read like an archive: up to
the first folder of a hundred that is missing.  One silo is one partition; its
size is bounded by the archive's configuration, and small ones share a
partition.  A file is read in blocks, and a
task holds one batch of records, some megabytes or one record.

Writing takes rows (silo, record), or (record_id, headers, body), that come
clustered and in order; without ``silo`` each task fills one silo behind the
largest number present.  A silo is staged under ``.hold`` and gets its name when
the job commits.  A silo that is
there already makes the job fail, unless ``append`` is ``true``: then the staged
file starts with the present bytes and takes its place if those haven't changed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.bytes_ops import good_length, member
from . import files

#: The members' end of a record decompresses to CR LF CR LF.
SEPARATOR = member(b"\r\n\r\n", 0)

SCHEMA = (
    "path string, silo int, offset long, record_id string, warc_type string, warc_date string, content_type string, content_length string, block_digest string, payload_digest string, "
    "refers_to string, segment_number string, segment_origin_id string, segment_total_length string, headers map<string,string>, header_gz_len long, body_gz_len long, body binary, error string, body_gz binary, body_len long, end_offset long, version string"
)
_FIELDS = {"warc-type": 4, "warc-date": 5, "content-type": 6, "content-length": 7, "warc-block-digest": 8, "warc-payload-digest": 9, "warc-refers-to": 10, "warc-segment-number": 11, "warc-segment-origin-id": 12, "warc-segment-total-length": 13}


def parse_header(text: str) -> tuple[str | None, dict[str, str], str | None]:
    """Record id, fields (a repeated name's last value), and what is wrong."""
    lines = text.split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return None, {}, "no version line"
    fields: dict[str, str] = {}
    record_id = None
    for i, line in enumerate(lines[1:]):
        if not line:
            break
        name, colon, value = line.partition(":")
        if not colon:
            return record_id, fields, f"field without a colon: {name[:40]}"
        if i == 0:
            if name.lower() != "warc-record-id":
                return None, fields, "the record id isn't the first field"
            m = re.fullmatch(r"\s*<(?:.*/)?([0-9a-fA-F]+)>\s*", value)
            record_id = m[1] if m else None
            continue
        fields[name.lower()] = value.strip()
    return record_id, fields, None if record_id else "no record id"


_BLOCK = 1 << 20
#: Bytes of silos in one partition, if there is more than one.
_GROUP = 1 << 26
#: Rows and bytes after which a batch of records goes to Spark.
_ROWS, _BYTES = 1000, 1 << 22

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


class _Stream:
    """A file read forward in blocks, with its place."""

    def __init__(self, path: str, at: int):
        system, inner = files.split(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.file.seek(at)
        self.at, self.kept, self.used = at, b"", 0

    def peek(self, n: int) -> bytes:
        if len(self.kept) - self.used < n:
            parts, have = [self.kept[self.used :]], len(self.kept) - self.used
            while have < n and (more := self.file.read(max(_BLOCK, n - have))):
                parts.append(more)
                have += len(more)
            self.kept, self.used = b"".join(parts), 0
        return self.kept[self.used : self.used + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.used += len(out)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        self.at += n
        self.used += n
        if self.used > len(self.kept):
            self.kept, self.used = b"", 0
            self.file.seek(self.at)

    def unpack(self, keep: bool = True) -> tuple[bytes, int]:
        """Content and length of the member that begins here."""
        stated = good_length(self.peek(20))
        if stated is not None and stated <= min(_BLOCK, self.size - self.at):  # most members: no more is looked at than theirs
            reader = zlib.decompressobj(31)
            content = reader.decompress(self.peek(stated))
            if reader.eof and not reader.unused_data:
                self.skip(stated)
                return content if keep else len(content).to_bytes(8, "big"), stated
        reader, parts, start, content = zlib.decompressobj(31), [], self.at, 0
        while not reader.eof:
            block = self.take(_BLOCK)
            if not block:
                raise ValueError("the member doesn't end")
            part = reader.decompress(block)
            content += len(part)
            if keep:
                parts.append(part)
        rest = reader.unused_data
        self.kept, self.used, self.at = rest + self.kept[self.used :], 0, self.at - len(rest)
        return b"".join(parts) if keep else content.to_bytes(8, "big"), self.at - start


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``read_silo`` as batches that end at some rows or megabytes."""
    held, total = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held))
        columns[14] = [x if x is None else list(x.items()) for x in columns[14]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    for row in rows:
        held.append(row)
        total += len(row[17] or b"") + len(row[19] or b"")
        if len(held) >= _ROWS or total >= _BYTES:
            yield batch()
            total = 0
    if held:
        yield batch()


def read_silo(path: str, body: bool, lenient: bool, raw: bool = False, at: int = 0) -> Iterator[tuple]:
    number = re.search(r"(\d+)[^/]*$", path)
    silo = int(number[1]) if number else None
    stream = _Stream(path, at)
    while stream.at < stream.size:
        row: list = [path, silo, stream.at] + [None] * 20
        try:
            head, row[15] = stream.unpack()
            row[22] = head[:8].decode("ascii", "replace")
            row[3], fields, row[18] = parse_header(head.decode("utf-8", "replace"))
            for name, place in _FIELDS.items():
                row[place] = fields.get(name)
            row[14] = fields
            stated = good_length(stream.peek(20))
            if stated is None and not lenient:
                raise ValueError("the body lacks its length field")
            if raw and stated is not None:
                row[19] = stream.peek(stated)
            if body or stated is None:
                content, row[16] = stream.unpack(body)
                row[20] = len(content) if body else int.from_bytes(content, "big")
                row[17] = content if body else None
                if stated is not None and stated != row[16]:
                    row[18] = row[18] or f"bad gzip length ({stated} vs {row[16]})"
            else:
                row[16] = stated
                stream.skip(stated)
            row[21] = stream.at
            if stream.unpack()[0] != b"\r\n\r\n":
                row[18] = row[18] or "bad separator"
        except (ValueError, zlib.error) as e:
            row[18] = str(e)
            yield tuple(row)
            return
        yield tuple(row)


def silo_number(path: str) -> int:
    found = re.search(r"(\d+)[^/]*$", path)
    return int(found[1]) if found else -1


def enumerate_silos(root: str) -> list[str]:
    """The silo files below a folder by number; of an archive, up to the first
    folder of a hundred silos that is missing."""
    found = sorted((silo_number(p), p) for p, *_ in files.listed(root, ".warc.gz"))
    _, top = files.split(root)
    levels = {p[len(top) :].strip("/").split("/")[0] for _, p in found}
    if found and all(x.isdigit() for x in levels):
        folder, seen = 0, {n // 100 for n, _ in found}
        while folder in seen or files.exists(f"{root.rstrip('/')}/{silo_folder(folder * 100)}"):
            folder += 1
        found = [(n, p) for n, p in found if n // 100 < folder]
    return [p for _, p in found]


def silo_folder(number: int) -> str:
    """``0/``, ``1/01/``, ``2/01/23/``: the level, then two digits a level."""
    groups, rest = [], number // 100
    while rest:
        groups.append(f"{rest % 100:02d}/")
        rest //= 100
    return f"{len(groups)}/" + "".join(reversed(groups))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"], dict(options)

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if self.path.endswith(".warc.gz") else enumerate_silos(self.path)
        if "silo" in self.options:
            wanted = {int(x) for x in self.options["silo"].split(",") if x}
            found = [p for p in found if silo_number(p) in wanted]
        groups, total = [[]], 0  # small silos share a partition; there are 32 partitions at least, if as many silos
        for path in found:
            size = files.size(path)
            if groups[-1] and (total + size > _GROUP or len(groups[-1]) * 32 >= len(found)):
                groups.append([])
                total = 0
            groups[-1].append(path)
            total += size
        return [InputPartition(x) for x in groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        on = lambda name: self.options.get(name, "false") == "true"
        yield from batched(row for path in partition.value for row in read_silo(path, on("body"), on("lenient"), on("raw"), int(self.options.get("offset", 0))))


def encode(record_id: str, headers: dict[str, str], body: bytes) -> bytes:
    """The three members of a record."""
    fields = "".join(f"{k}: {v}\r\n" for k, v in sorted(headers.items(), key=lambda x: x[0].lower()))
    return member(f"WARC/1.1\r\nWARC-Record-ID: <{record_id}>\r\n{fields}\r\n".encode(), 0) + member(body) + SEPARATOR


class _Writer(DataSourceArrowWriter):
    """Rows (silo, record): each silo's records one after another.  Of a batch
    one record at a time is taken out."""

    def __init__(self, options: dict):
        self.path, self.append = options["path"].rstrip("/"), options.get("append", "false") == "true"
        self.basename = options.get("basename", "%08d.warc.gz")
        self.first = max([silo_number(p) for p, *_ in files.listed(self.path, ".warc.gz")], default=-1) + 1

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        message = WriterCommitMessage()
        message.staged = []
        out, now, attempt = None, None, TaskContext.get().taskAttemptId()
        try:
            for row in ({n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)} for b in batches for i in range(b.num_rows)):
                silo = row["silo"] if "silo" in row else self.first + TaskContext.get().partitionId()
                if silo != now:
                    if out is not None:
                        out.close()
                    now = silo
                    final = f"{self.path}/{silo_folder(now)}{self.basename % now}"
                    hold, before = f"{final}.{attempt}.hold", -1
                    files.make_parent(hold)
                    system, inner = files.split(hold)
                    out = system.open_output_stream(inner, compression=None)
                    message.staged.append((hold, final, before))
                    if files.exists(final):
                        if not self.append:
                            raise FileExistsError(f"silo {now} is there already")
                        with system.open_input_stream(files.split(final)[1], compression=None) as old:
                            before = 0
                            while block := old.read(_BLOCK):
                                out.write(block)
                                before += len(block)
                        message.staged[-1] = (hold, final, before)
                out.write(row["record"] if "record" in row else encode(row["record_id"], dict(row["headers"] or {}), row["body"] or b""))
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            for hold, *_ in message.staged:
                files.remove(hold)
            raise
        return message

    def commit(self, messages: list) -> None:
        for m in messages:
            for hold, final, before in m.staged if m is not None else ():
                if before < 0:
                    files.install(hold, final)
                else:
                    files.replace(hold, final, before)

    def abort(self, messages: list) -> None:
        for m in messages:
            for hold, *_ in m.staged if m is not None else ():
                files.remove(hold)


class SiloSource(DataSource):
    """``spark.read.format("silo")`` and ``df.write.format("silo")``."""

    @classmethod
    def name(cls) -> str:
        return "silo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("silos are never overwritten")
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SiloSource)
