"""WARC archives: writing with revisit records, and reading by boundary chains.

Writing.  Every page becomes one record.  Of pages with equal payloads the one
with the largest page_id is a ``response`` record, the others are ``revisit``
records that refer to it and carry no payload.  Records go through Spark's text
writer (the line separator is WARC's record end), so any file system that Spark
reaches can hold them.

Reading.  Spark's text reader splits the files at the version line, whatever
task a split falls to, so a version line inside a payload yields a false
candidate.  Each task emits, for its candidates, the offset of the record and
of its successor (from Content-Length).  Within a split, runs of candidates
whose successor is the next candidate compact into islands; pointer jumping
over the islands from the start of each file keeps what is reachable and
thereby rejects version lines inside payloads.  Offsets are running sums within
a split plus the sizes of the splits before it, so no task sees more than one
split of a file.  Payloads that version lines cut in pieces are put together
again from a second scan, which finds the pieces by a digest of their text:
nothing depends on both scans splitting the files alike.

All of it runs in the JVM.  Defined results: null html is an empty payload; a
null url leaves out the target header; a null page_id is below all others and
comes back as null; rows that repeat the largest page_id of their payload are
all responses; an empty table writes and reads no record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, table

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(data: F.Column) -> F.Column:
    """Upper-case base32 of a SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row a page: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    source = source.withColumns({"payload_digest": base32_sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    first = source.groupBy(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).agg(F.max("page_id").alias("first_id"))
    first = materialize(first, "warc-first")  # so that the join below can split a frequent payload
    joined = source.join(first, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes")))
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url",
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _header(name: str, value: F.Column) -> F.Column:
    """One header line; left out for a null, line breaks percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_a_file: int = 50_000) -> None:
    """Write ``records`` rows as uncompressed WARC 1.1 files."""
    block = F.concat(F.lit(_HTTP), F.col("payload_bytes"), F.lit(END), F.coalesce(F.col("payload"), F.lit("")))
    revisit = F.col("record_type") == "revisit"
    record = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.col("page_id"), F.col("payload_digest")), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("X-Page-ID", F.col("page_id")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), _uuid(F.col("refers_to"), F.col("payload_digest")), F.lit(">")))),
        _header("X-Refers-To-Page-ID", F.col("refers_to")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_a_file).text(path)


#: Bytes of a file that share a bucket when pieces are looked up by place.
_SPAN = 1 << 20


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, in any order: the file, its split, the
    row's number in the task, the text and a digest of it."""
    raw = spark.read.option("lineSep", VERSION).option("recursiveFileLookup", "true").text(path)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("part")]
    return raw.select(*meta, F.monotonically_increasing_id().alias("row"), F.col("value"), F.unhex(F.md5(F.col("value").cast("binary"))).alias("sum"))


def _field(head: F.Column, name: str) -> F.Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk with its offset, its parsed header, its successor's offset and
    its island: within a split, a run of candidates each of which is the
    successor of the last.

    Only narrow rows go through the windows, a split's rows through one."""
    chunk = _chunks(spark, path)
    head = F.substring_index("value", END, 1)
    raw = F.col("value").cast("binary")
    parsed = chunk.withColumns({"bytes": F.octet_length("value").cast("long"), "head": head}).withColumns({
        "head_bytes": F.octet_length("head").cast("long") + 4,
        "content_length": F.expr("try_cast(regexp_extract(concat('\\r\\n', head), '(?i)\\r\\nContent-Length:[ \\t]*([0-9]+)[ \\t]*(\\r|$)', 1) as bigint)"),
        "record_type": _field(F.col("head"), "WARC-Type"),
        "page_id": _field(F.col("head"), "X-Page-ID").cast("long"),
        "url": _field(F.col("head"), "WARC-Target-URI"),
        "refers_to": _field(F.col("head"), "X-Refers-To-Page-ID").cast("long"),
        "stated_digest": F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", ""),
    })
    content = F.expr("substring(cast(value as binary), cast(head_bytes + 1 as int), cast(content_length as int))")
    parsed = parsed.withColumn("whole", (F.col("content_length").isNotNull()) & (F.col("bytes") == F.col("head_bytes") + F.col("content_length") + 4) & (F.expr("right(value, 4)") == END))
    parsed = parsed.withColumn("content", F.when(F.col("whole"), content)).withColumns(_payload(F.col("content")))
    narrow = materialize(parsed.drop("value", "head", "content"), "warc-candidates")
    splits = narrow.groupBy("file", "part").agg(F.sum(F.col("bytes") + len(VERSION)).alias("size"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.select("file", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    order = Window.partitionBy("file", "part").orderBy("row")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumns({"within": F.coalesce(F.sum(F.col("bytes") + len(VERSION)).over(running), F.lit(0)), "nth": F.row_number().over(order) - 1})
    placed = placed.join(materialize(splits, "warc-splits"), ["file", "part"])
    # the first chunk of a file lies before its first version line
    placed = placed.withColumns({"nth": F.col("nth") + F.col("rows_before"), "at": F.col("before") + F.col("within") - len(VERSION)}).drop("within", "before", "rows_before")
    step = F.col("at") + len(VERSION) + F.col("head_bytes") + F.col("content_length") + 4
    placed = placed.withColumn("next_at", F.when(F.col("record_type").isNotNull() & (step <= F.col("file_size")), step))
    follows = F.coalesce(F.lag("next_at").over(order) == F.col("at"), F.lit(False))
    placed = placed.withColumn("fresh", F.when(follows, 0).otherwise(1))
    return placed.withColumn("island", F.struct("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))).drop("fresh")


def _payload(content: F.Column) -> dict[str, F.Column]:
    """Digest and length of the HTTP payload in a record's content, and the
    length that the HTTP header states."""
    text = content.cast("string")
    head = F.octet_length(F.substring_index(text, END, 1)) + 4
    body = F.call_function("substring", content, (head + 1).cast("int"))
    return {
        "payload_digest": base32_sha1(body),
        "payload_bytes": F.octet_length(body).cast("long"),
        "stated_bytes": F.regexp_extract(F.substring_index(text, END, 1), r"(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1),
    }


def _entries(found: DataFrame) -> DataFrame:
    """The islands on the chain of successors from the start of their file:
    file, island, entry (the offset at which the chain enters the island).

    There is one row for each split of a file and for each place where a payload
    holds a version line, so what moves here doesn't grow with ordinary records."""
    keys = found.where("nth > 0")
    islands = materialize(keys.groupBy("file", "island").agg(F.min("at").alias("begin"), F.max_by("next_at", "nth").alias("exit")), "warc-islands")
    inner = keys.select("file", F.col("at").alias("exit"), F.col("island").alias("next"))
    hits = inner.join(islands.select("file", "exit", "island"), ["file", "exit"]).select("file", "island", "next")
    jump = materialize(islands.join(hits, ["file", "island"], "left"), "warc-jumps")
    reach = jump.where("begin = 0").select("file", "island")
    hop, known = jump.where("next is not null").select("file", "island", "next"), reach.count()
    while hop.take(1):
        reach = materialize(reach.union(reach.join(hop, ["file", "island"]).select("file", F.col("next").alias("island"))).distinct(), "warc-reach")
        if (now := reach.count()) == known:
            break
        known = now
        further = hop.select("file", F.col("island").alias("next"), F.col("next").alias("after"))
        hop = materialize(hop.join(further, ["file", "next"]).select("file", "island", F.col("after").alias("next")), "warc-hops")
    entered = jump.join(reach, ["file", "island"]).where("next is not null").select("file", F.col("next").alias("island"), F.col("exit").alias("entry"))
    start = jump.where("begin = 0").select("file", "island", F.lit(0).cast("long").alias("entry"))
    return entered.union(start).groupBy("file", "island").agg(F.max("entry").alias("entry"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, intact.

    ``payload_bytes`` and ``payload_digest`` are measured on responses and taken
    from the headers on revisits; ``intact`` says whether the measured digest
    and length equal the stated ones (null on revisits)."""
    found = materialize(candidates(spark, path), "warc-places")
    entries = materialize(_entries(found), "warc-entries")
    kept = found.join(entries, ["file", "island"]).where("at >= entry")
    cut = kept.where("not whole").select("file", F.col("at").alias("owner"), F.col("next_at").alias("until"), F.col("head_bytes").alias("skip"), F.col("content_length").alias("length"))
    if cut.take(1):
        spread = cut.withColumn("bucket", F.explode(F.sequence(F.expr(f"owner div {_SPAN}"), F.expr(f"until div {_SPAN}"))))
        pieces = found.where("nth > 0").select("file", F.expr(f"at div {_SPAN}").alias("bucket"), "at", "sum", "bytes")
        pieces = pieces.join(spread, ["file", "bucket"]).where("at >= owner and at < until").drop("bucket")
        pieces = materialize(pieces, "warc-pieces")
        texts = _chunks(spark, path).withColumn("bytes", F.octet_length("value").cast("long")).select("sum", "bytes", "value")
        wanted = pieces.select("sum", "bytes").distinct()
        texts = texts.join(wanted, ["sum", "bytes"], "left_semi").groupBy("sum", "bytes").agg(F.first("value").alias("value"))
        text = pieces.join(texts, ["sum", "bytes"])
        joined = text.groupBy("file", "owner", "skip", "length").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
        whole = F.array_join(F.transform("parts", lambda x: x["value"]), VERSION)
        content = F.call_function("substring", whole.cast("binary"), (F.col("skip") + 1).cast("int"), F.col("length").cast("int"))
        mended = joined.withColumn("content", content).withColumns(_payload(F.col("content")))
        mended = mended.select("file", F.col("owner").alias("at"), *[F.col(c).alias(f"m_{c}") for c in ("payload_digest", "payload_bytes", "stated_bytes")])
        kept = kept.join(mended, ["file", "at"], "left")
        for c in ("payload_digest", "payload_bytes", "stated_bytes"):
            kept = kept.withColumn(c, F.when(F.col("whole"), F.col(c)).otherwise(F.col(f"m_{c}")))
    revisit = F.col("record_type") == "revisit"
    stated = F.expr("try_cast(stated_bytes as bigint)")
    return kept.select(
        "page_id", "url", "record_type",
        F.when(revisit, stated).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "refers_to",
        F.when(~revisit, (F.col("payload_digest") == F.col("stated_digest")) & (F.col("payload_bytes") == stated)).alias("intact"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page, read the archives back."""
    path = new_path(spark, "warc")
    write_archives(records(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + cast((cast('0x' || substr(h, cast(1 + 10 * (k // 8) as bigint), 10) as bigint) >> (35 - 5 * (k % 8))) & 31 as bigint), 1)), '') as payload_digest
  from p
), w as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as first_id from d)
select page_id, payload_bytes, payload_digest,
  case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from w
"""
