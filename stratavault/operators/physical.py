"""Operators on silo files: encoding, placing, reindexing, audit, retrieval.

``records`` is what ``format("silo")`` reads.  Objects are checked and digested
by streaming over rows that are clustered by object and sorted by segment, so a
task holds one batch of segments, never a whole object."""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import bytes_ops as B

# --- store ------------------------------------------------------------------------------


def record_headers(segments: DataFrame, date: str) -> DataFrame:
    """Segments with their serialised header: seq, number, segment_id, header, body."""
    several, number = F.col("n_segments") > 1, F.col("number")
    refers = X.ref_header(F.col("refers_to")) if "refers_to" in segments.columns else F.lit(None).cast("string")
    fields = [
        ("Content-Length", F.col("segment_length").cast("string")),
        ("Content-Type", F.when(number == 1, F.col("content_type"))),
        ("WARC-Block-Digest", X.digest_header(F.col("body"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.when(several & (number == 1), F.concat(F.lit("sha256:"), "sha"))),
        ("WARC-Refers-To", F.when(number == 1, refers)),
        ("WARC-Segment-Number", F.when(several, number.cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(several & (number > 1), F.concat(F.lit("<"), X.with_prefix(F.col("id")), F.lit(">")))),
        ("WARC-Segment-Total-Length", F.when(several & (number == F.col("n_segments")), F.col("length").cast("string"))),
        ("WARC-Type", F.when(number == 1, F.col("warc_type")).otherwise("continuation")),
    ]
    headers = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in fields]), lambda e: e["value"].isNotNull()))
    return segments.select("seq", "number", "segment_id", X.serialize_header(F.col("segment_id"), headers).alias("header"), "body")


def encode_records(rows: DataFrame) -> DataFrame:
    """(seq, number, header, body) to (seq, number, record, size): the members of each record."""
    end = B.member(b"\r\n\r\n", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, total = 0, [], 0
            for i in range(batch.num_rows):
                header, body = batch.column(2)[i].as_py(), batch.column(3)[i].as_py() or b""
                held.append(B.member(header.encode(), 0) + B.member(body) + end)
                total += len(held[-1])
                if total >= 1 << 22 or i + 1 == batch.num_rows:
                    keys = [c.slice(begin, len(held)) for c in batch.columns[:2]]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(held, pa.binary()), pa.array([len(x) for x in held], pa.int64())], names=["seq", "number", "record", "size"])
                    begin, held, total = i + 1, [], 0

    rows = rows.select(F.col("seq").cast("long").alias("seq"), F.col("number").cast("long").alias("number"), "header", F.col("body").cast("binary").alias("body"))
    return rows.mapInArrow(run, "seq long, number long, record binary, size long")


def place_by_size(rows: DataFrame, width: int, first: int = 0) -> DataFrame:
    """Rows with (uid, size), whose uid grows in order and has the task in its
    upper bits, with ``silo``: silos of ``width`` bytes, by where a record begins.

    Sums run within a task's rows; only one row a task goes through one window."""
    part = F.shiftright("uid", 33)
    sums = rows.groupBy(part.alias("part")).agg(F.sum("size").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("part").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("part", part).withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return within.join(sums, "part").select(*rows.columns, (F.lit(first) + F.floor((F.col("base") + F.col("at")) / width)).cast("int").alias("silo"))


#: Records are in order by these; the last, a hash of the record, decides between equal places.
ORDER = ("seq", "number", "tie")


def in_silos(rows: DataFrame, starts: list[tuple]) -> DataFrame:
    """Records with the silo whose first record's (seq, number, tie) is theirs or
    the last one before it: ``starts`` has (silo, seq, number, tie), a row a silo.

    Only the place of a record goes to Python; its bytes move when silos are
    written."""
    silos = [s[0] for s in sorted(starts)]
    least = -(1 << 63)
    firsts = [tuple(least if x is None else x for x in s[1:]) for s in sorted(starts)]

    def find(seq: pa.Array, number: pa.Array, tie: pa.Array) -> pa.Array:
        keys = zip(seq.fill_null(least).to_pylist(), number.to_pylist(), tie.to_pylist())
        return pa.array([silos[bisect.bisect_right(firsts, k) - 1] for k in keys], pa.int32())

    return rows.withColumn("silo", F.arrow_udf(find, "int")(*ORDER))


def warcinfo_headers(bodies: DataFrame, date: str) -> DataFrame:
    """The warcinfo record of each silo (silo, body, id) as seq, number, header, body."""
    headers = F.create_map(
        F.lit("Content-Length"), F.octet_length("body").cast("string"), F.lit("Content-Type"), F.lit("application/warc-fields"), F.lit("WARC-Block-Digest"), X.digest_header(F.col("body")),
        F.lit("WARC-Date"), F.lit(date), F.lit("WARC-Filename"), X.silo_path(F.col("silo")), F.lit("WARC-Type"), F.lit("warcinfo"),
    )
    return bodies.select(F.col("silo").cast("long").alias("seq"), F.lit(0).alias("number"), X.serialize_header(F.col("id"), headers).alias("header"), F.col("body").cast("binary").alias("body"))


# --- index ------------------------------------------------------------------------------


def origin_of(record_id: Column, number: Column, origin: Column) -> Column:
    """The object that a segment belongs to; its own id for a first one."""
    return F.when(number.try_cast("long") > 1, F.lower(X.bare_id(origin))).otherwise(F.lower(record_id))


def reindex(records: DataFrame) -> DataFrame:
    """Index rows from record headers; ``matched`` is false for a segment that
    isn't the last one and whose successor isn't there."""
    number = F.when(F.col("segment_number").rlike("^[0-9]*$"), F.coalesce(F.col("segment_number").try_cast("long"), F.lit(0)))
    rows = records.where("record_id is not null").select(F.lower("record_id").alias("id"), "warc_type", "silo", "offset", number.alias("number"), F.col("segment_total_length").isNotNull().alias("last"), origin_of(F.col("record_id"), F.col("segment_number"), F.col("segment_origin_id")).alias("origin"))
    kind = X.type_flag(F.col("warc_type"))
    flags = F.when(F.col("number").isNull(), kind).otherwise(
        kind.bitwiseOR(F.lit(X.SEGMENTED)).bitwiseOR(F.when(F.col("number") > 1, 0).otherwise(X.FIRST)).bitwiseOR(F.when(F.col("last"), X.LAST).otherwise(0))
    )
    order = Window.partitionBy("origin").orderBy("number")  # a whole record, without a number, comes first
    after = F.when(F.lead("number").over(order) == F.col("number") + 1, F.lead("id").over(order))
    rows = rows.withColumn("after", F.when(F.col("number").isNotNull() & ~F.col("last"), after))
    cont = F.coalesce(F.substring("after", 1, 8), F.lit("00000000"))
    return rows.select(X.key_of(F.col("id")).alias("key"), flags.cast("int").alias("flags"), "silo", "offset", cont.alias("cont"), (F.col("number").isNull() | F.col("last") | F.col("after").isNotNull()).alias("matched"))


def rematch(found: DataFrame, index: DataFrame) -> DataFrame:
    """Segments without a successor take ``cont`` from an index entry of the same
    first 16 digits; ``matched`` says whether there is one."""
    left = found.where("not matched").drop("cont", "matched").withColumn("short", F.substring("key", 1, 16))
    known = index.where(X.has_flag(F.col("flags"), X.SEGMENTED)).groupBy(F.substring("key", 1, 16).alias("short")).agg(F.max("cont").alias("cont"))
    again = left.join(known, "short", "left").select("key", "flags", "silo", "offset", F.coalesce("cont", F.lit("00000000")).alias("cont"), F.col("cont").isNotNull().alias("matched"))
    return found.where("matched").unionByName(again)


def out_of_order(index: DataFrame) -> DataFrame:
    """Rows of a range-sorted index that come before their predecessor in their
    file partition: none, if the merge kept its order."""
    marked = index.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    whole = F.concat_ws("/", "key", F.lpad(F.col("flags").cast("string"), 4, "0"), F.lpad(F.col("silo").cast("string"), 10, "0"), F.lpad(F.col("offset").cast("string"), 20, "0"), "cont")
    before = F.lag(whole).over(Window.partitionBy("part").orderBy("at"))
    return marked.withColumn("before", before).where(F.col("before") > whole).drop("before", "at", "part")


# --- objects ----------------------------------------------------------------------------

def clustered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key in one partition, one after another, in order.

    The exchange is by a hash of the key, which no join below has done: one by
    the key itself would be dropped as already there, and adaptive execution
    could then read that join's shuffle locally and take a key apart."""
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


_OBJECT = "id string, n_segments int, chained boolean, total_length long, gz_length long, digest string, crc long"


def digest_objects(parts: DataFrame, packed: bool = False) -> DataFrame:
    """(id, number, body, gz) to one row an object: lengths, digest and CRC of
    the bodies in order, and whether the numbers run from 1 without a gap.
    Bodies that are ``packed`` are gzip members, unpacked one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def finish() -> None:
            n, chained, total, gz, sha, crc = state
            done.append((now, n, chained, total, gz, sha.hexdigest(), crc))

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*done)) if done else [()] * 7
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _OBJECT.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                id_, number, body, gz = (batch.column(k)[i].as_py() for k in range(4))
                if state is None or id_ != now:
                    if state is not None:
                        finish()
                    now, state = id_, [0, True, 0, 0, hashlib.sha256(), 0]
                body = zlib.decompress(body, 31) if packed and body else body or b""
                state[1] &= number == state[0] + 1
                state[0], state[2], state[3], state[5] = state[0] + 1, state[2] + len(body), state[3] + (gz or 0), zlib.crc32(body, state[5])
                state[4].update(body)
            yield flush()
        if state is not None:
            finish()
            yield flush()

    rows = parts.select("id", F.col("number").cast("long").alias("number"), F.col("body").cast("binary").alias("body"), F.col("gz").cast("long").alias("gz"))
    return clustered(rows, "id", "number").mapInArrow(run, _OBJECT)


def locate(ids: DataFrame, index: DataFrame, records: DataFrame) -> DataFrame:
    """(pos, id) to the record that an id names, through the index: the header's
    columns, and ``problem`` where the id can't be got."""
    wanted = ids.select("pos", "id", X.key_of(F.col("id")).alias("key"))
    places = wanted.join(index.select("key", "flags", "silo", "offset"), "key").drop("key")
    heads = records.drop("body", "body_gz") if "body" in records.columns else records
    hits = places.join(heads, ["silo", "offset"]).where(F.lower("record_id") == F.lower("id"))
    first = hits.groupBy("pos").agg(F.min_by(F.struct(*[c for c in hits.columns if c != "pos"]), F.struct("silo", "offset")).alias("r")).select("pos", "r.*")
    out = wanted.select("pos", "id").join(first.drop("id"), "pos", "left")
    flags = F.col("flags")
    problem = (
        F.when(flags.isNull(), "ID not found")
        .when(X.has_flag(flags, X.WARCINFO), "ID is warcinfo segment")
        .when(X.has_flag(flags, X.SEGMENTED) & ~X.has_flag(flags, X.FIRST), "ID is continuation segment")
    )
    return out.withColumn("problem", problem)


def get_objects(ids: DataFrame, index: DataFrame, heads: DataFrame, records: DataFrame) -> DataFrame:
    """(pos, id) to what a retrieval finds: pos, id, n_segments, total_length,
    digest, content_type, verified, problem.

    ``heads`` are the records without bodies, ``records`` those with them; each
    is read once.  The index gives the first record by (silo, offset); the other
    segments are those that name it as their origin.  Verified: the payload digest, or else
    the block digest, and the total length, or else the content length, are those
    of the bodies, and the segments are numbered without a gap."""
    found = locate(ids, index, heads)
    first = found.where("problem is null").select(F.lower("id").alias("id"), F.col("silo").alias("at_silo"), F.col("offset").alias("at")).distinct()
    number = F.coalesce(F.col("segment_number").try_cast("int"), F.lit(1))
    bodies = records.select(origin_of(F.col("record_id"), F.col("segment_number"), F.col("segment_origin_id")).alias("id"), number.alias("number"), "silo", "offset", "body", F.col("body_gz_len").alias("gz"), "segment_total_length")
    parts = bodies.join(first, "id").where("number > 1 or silo = at_silo and offset = at").select("id", "number", "body", "gz", "segment_total_length")
    totals = parts.groupBy("id").agg(F.max("segment_total_length").alias("stated_total"))
    whole = digest_objects(parts).join(totals, "id")
    stated = F.coalesce("payload_digest", "block_digest") == F.concat(F.lit("sha256:"), "digest")
    length = F.coalesce("stated_total", "content_length") == F.col("total_length").cast("string")
    joined = found.join(whole.withColumnRenamed("id", "__id"), F.lower("id") == F.col("__id"), "left")
    ended = ~X.has_flag(F.col("flags"), X.SEGMENTED) | F.col("stated_total").isNotNull()
    problem = F.coalesce("problem", F.when(~(F.col("chained") & ended), "Index Inconsistency: Continuation out of order."))
    return joined.select("pos", "id", "n_segments", "total_length", "gz_length", "digest", "content_type", F.coalesce(F.col("problem").isNull() & stated & length & F.col("chained") & ended, F.lit(False)).alias("verified"), problem.alias("problem"))


def respond(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """The response head of each request (pos, path_info, accept_encoding) from
    what ``get_objects`` found for it.  A segmented object isn't sent as gzip."""
    rows = requests.join(objects, "pos")
    packed = X.wants_gzip(F.col("accept_encoding")) & (F.col("n_segments") == 1)
    good = F.concat(
        F.lit("Content-Type: "), F.coalesce("content_type", F.lit("application/binary")), F.lit("\n"), F.when(packed, "Content-Encoding: gzip\n").otherwise(""),
        F.lit("Content-Length: "), F.when(packed, F.col("gz_length")).otherwise(F.col("total_length")), F.lit("\nStatus: 200\n\n"),
    )
    bad = F.concat(F.lit("Content-Type: text/html\nStatus: 501 Error\n\n<html><pre>"), "problem", F.lit("\n</pre></html>"))
    return rows.select("pos", F.when(F.col("problem").isNull(), good).otherwise(bad).alias("response"))


# --- audit ------------------------------------------------------------------------------


def record_problems(records: DataFrame, ignore_metadata_id: bool = False) -> DataFrame:
    """``records`` with ``problems``: everything wrong with a record by itself."""
    body = F.col("body")
    sha, size = X.digest(body), F.octet_length(body).cast("string")
    block, number = F.col("block_digest"), F.col("segment_number")

    def problem(text: str, stated: Column, found: Column) -> Column:
        return F.struct(F.lit(text).alias("problem"), stated.cast("string").alias("stated"), found.cast("string").alias("found"))

    own = F.when(F.col("warc_type") == "metadata", F.substring(F.sha2(F.concat("refers_to", F.lit("\n"), sha, F.lit("\n")).cast("binary"), 256), 1, X.ID_SIZE)).otherwise(F.substring(sha, 1, X.ID_SIZE))
    named = number.isNull() | (number != "1")
    if ignore_metadata_id:
        named &= F.col("warc_type") != "metadata"
    checks = F.array(
        F.when(F.col("error").isNotNull(), problem("unreadable record", F.col("error"), F.lit(None))),
        F.when(F.col("end_offset") - F.col("offset") != F.col("header_gz_len") + F.col("body_gz_len"), problem("Bad GZIP length", F.col("body_gz_len"), F.col("end_offset") - F.col("offset") - F.col("header_gz_len"))),
        F.when(block.isNull(), problem("WARC-Block-Digest missing", block, sha))
        .when(~block.startswith("sha256:"), problem("WARC-Block-Digest is not sha256", block, sha))
        .when(block != F.concat(F.lit("sha256:"), sha), problem("WARC-Block-Digest difference", block, sha)),
        F.when(F.col("content_length").isNull(), problem("Content-Length missing", F.lit(None), size)).when(F.col("content_length") != size, problem("Content-Length difference", F.col("content_length"), size)),
        F.when(~number.rlike("^[0-9]+$"), problem("Bad WARC-Segment-Number", number, F.lit(None))),
        F.when(named & (~F.col("record_id").eqNullSafe(own)), problem("WARC-Record-ID difference", F.col("record_id"), own)),
    )
    return records.withColumn("problems", F.array_compact(checks))


def audit_silos(records: DataFrame, ignore_metadata_id: bool = False) -> DataFrame:
    bad = F.size("problems") > 0
    return record_problems(records, ignore_metadata_id).groupBy("silo").agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))


def audit_report(records: DataFrame, ignore_metadata_id: bool = False) -> DataFrame:
    """Each problem with its record's place and headers."""
    found = record_problems(records, ignore_metadata_id).select("silo", "offset", "end_offset", "record_id", "headers", F.explode("problems").alias("p"))
    return found.select("silo", "offset", "end_offset", "record_id", "p.problem", "p.stated", "p.found", "headers")


def _segments(records: DataFrame) -> DataFrame:
    rows = records.where("segment_number is not null")
    return rows.withColumn("number", F.col("segment_number").try_cast("long")).withColumn("id", origin_of(F.col("record_id"), F.col("segment_number"), F.col("segment_origin_id")))


def audit_objects(records: DataFrame) -> DataFrame:
    """Segmented objects that have a first segment: id, n_segments, problems.

    Segments count from 1 up to the first that states the total length; a gap
    before that is a missing segment."""
    rows = _segments(records)
    order = Window.partitionBy("id").orderBy("number", "silo", "offset")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("ended", F.coalesce(F.max(F.when(F.col("segment_total_length").isNotNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = rows.where("number = nth and ended = 0")
    stated = used.groupBy("id").agg(
        F.max("segment_total_length").alias("total"), F.max(F.when(F.col("number") == 1, F.col("payload_digest"))).alias("payload"), F.max(F.when(F.col("number") == 1, F.col("warc_type"))).alias("kind"),
        F.max(F.when(F.col("number") == 1, F.col("refers_to"))).alias("ref"), F.max(F.when(F.col("number") == 1, F.col("record_id"))).alias("record_id"),
    )
    whole = digest_objects(used.select("id", "number", "body", F.col("body_gz_len").alias("gz"))).join(stated, "id").where("record_id is not null")
    own = F.when(F.col("kind") == "metadata", F.substring(F.sha2(F.concat("ref", F.lit("\n"), "digest", F.lit("\n")).cast("binary"), 256), 1, X.ID_SIZE)).otherwise(F.substring("digest", 1, X.ID_SIZE))
    checks = F.array(
        F.when(F.col("total").isNull(), F.concat(F.lit("Failed to find segment "), (F.col("n_segments") + 1).cast("string"))).when(F.col("total") != F.col("total_length").cast("string"), F.lit("WARC-Segment-Total-Length difference")),
        F.when(F.col("total").isNotNull(), F.when(F.col("payload").isNull(), "WARC-Payload-Digest missing").when(~F.col("payload").startswith("sha256:"), "WARC-Payload-Digest is not sha256").when(F.col("payload") != F.concat(F.lit("sha256:"), "digest"), "WARC-Payload-Digest difference")),
        F.when(F.col("total").isNotNull() & (F.col("record_id") != own), "WARC-Record-ID difference"),
    )
    return whole.select("id", "n_segments", "total_length", "gz_length", F.array_compact(checks).alias("problems"))


def leftovers(records: DataFrame) -> DataFrame:
    """Segments that belong to no object: without a first one, or behind a gap."""
    rows = _segments(records).select("id", "number", "silo", "offset", "end_offset")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("number", "silo", "offset"))
    return rows.withColumn("nth", nth).where("number is null or number <> nth").select("id", F.col("number").alias("segment_number"), "silo", "offset", "end_offset")
