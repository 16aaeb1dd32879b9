"""Archive operators over payloads, records and the index.

Tables: payloads (seq, warc_type, content_type, payload), segments, index rows
(key, flags, silo, offset, cont), candidates (pos, line, id).  Every operator is
a plan over DataFrames; nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .physical import digest_objects


def identify(payloads: DataFrame, strict: bool = False) -> DataFrame:
    """Adds id, sha and length.  Empty payloads are left out, or an error if ``strict``.

    Metadata rows have their reference in ``refers_to``, which is part of their
    id; an id in ``forced_id`` stands before any computed one."""
    size = F.octet_length("payload")
    if strict:
        refused = F.raise_error(F.lit("empty input")).cast("boolean")
        rows = payloads.where(F.when(F.coalesce(size, F.lit(0)) > 0, F.lit(True)).otherwise(refused))
    else:
        rows = payloads.where(size > 0)
    rows = rows.withColumns({"sha": X.digest(F.col("payload")), "length": size.cast("long")})
    id_ = F.substring("sha", 1, X.ID_SIZE)
    if "refers_to" in payloads.columns:
        both = F.concat(X.ref_header(F.col("refers_to")), F.lit("\n"), F.col("sha"), F.lit("\n"))
        id_ = F.when(F.col("refers_to").isNotNull(), F.substring(F.sha2(both.cast("binary"), 256), 1, X.ID_SIZE)).otherwise(id_)
    if "forced_id" in payloads.columns:
        id_ = X.coalesced_id(F.col("forced_id"), id_)
    return rows.withColumn("id", id_)


def store_dedup(payloads: DataFrame, present: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """What a store adds: the first payload of each id that isn't present yet.

    Warcinfo and continuation entries of ``present`` don't count.  The window's
    limit drops copies in each task before the exchange, so a payload that is
    there very often travels once a task.  ``present`` meets the ids alone; the
    payloads, which lie by id already, then meet those that are there.  An anti
    join in that place would be moved below the window, and the limit lost."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    new = identify(payloads, strict).withColumn("nth", first).where("nth = 1").drop("nth")
    if present is not None:
        heads = present.where(X.has_flag(F.col("flags"), X.RESOURCE | X.METADATA)).select("key").distinct()
        ids = identify(payloads, strict).select("id").distinct().withColumn("key", X.key_of(F.col("id")))
        there = ids.join(heads, "key", "left_semi").select("id", F.lit(True).alias("__there"))
        new = new.join(there, "id", "left").where("__there is null").select(*new.columns)
    return new


def duplicates(payloads: DataFrame) -> DataFrame:
    return identify(payloads).groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("seq").alias("first_seq"))


def segments(objects: DataFrame, cap: int) -> DataFrame:
    """Objects cut at ``cap`` payload bytes: number, identity, flags and cont."""
    cut = objects.withColumn("n_segments", F.ceil(F.col("length") / cap).cast("int"))
    bodies = F.transform(F.sequence(F.lit(1), F.col("n_segments")), lambda k: F.call_function("substring", F.col("payload").cast("binary"), ((k - 1) * cap + 1).cast("int"), F.lit(cap)))
    kept = [c for c in cut.columns if c != "payload"]
    cut = cut.select(*kept, bodies.alias("bodies"))
    cut = cut.withColumn("ids", F.transform("bodies", lambda body, i: F.when(i == 0, F.col("id")).otherwise(X.ident(body))))
    cut = cut.withColumn("nexts", F.concat(F.slice("ids", 2, F.col("n_segments")), F.array(F.lit("00000000"))))
    cut = cut.select(*kept, F.posexplode(F.arrays_zip("bodies", "ids", "nexts")).alias("number", "part")).withColumn("number", F.col("number") + 1)
    cut = cut.select(*kept, "number", F.col("part.bodies").alias("body"), F.col("part.ids").alias("segment_id"), F.substring("part.nexts", 1, 8).alias("cont"))
    return cut.withColumns({"segment_length": F.octet_length("body").cast("long"), "flags": X.segment_flags(F.col("warc_type"), F.col("number"), F.col("n_segments"))})


def place(rows: DataFrame, per_silo: int, size: str = "segment_length") -> DataFrame:
    """Silo by arrival range and offset as the running size within the silo."""
    silo = F.floor(F.col("seq") / per_silo).cast("int")
    order = Window.partitionBy("silo").orderBy("seq", "number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("silo", silo).withColumn("offset", F.coalesce(F.sum(size).over(order), F.lit(0)).cast("long"))


def index_rows(placed: DataFrame) -> DataFrame:
    return placed.select(X.key_of(F.col("segment_id")).alias("key"), "flags", "silo", "offset", "cont")


def dump_index(index: DataFrame, parts: list[str] | None = None, flags: int | None = None) -> DataFrame:
    """Rows whose key starts with a part (once for each part) and whose flags
    equal ``flags`` exactly."""
    rows = index if flags is None else index.where(F.col("flags") == flags)
    found = None
    for part in parts or [""]:
        some = rows.where(F.col("key").startswith(part.lower()[:24]))
        found = some if found is None else found.unionByName(some)
    return found


def dump_line() -> Column:
    return F.format_string("%s 0x%08x %8d %12d %s", "key", "flags", "silo", "offset", "cont")


#: Fragments of so many digits or fewer count as short.
SHORT = 3


def by_id(index: DataFrame, fragments: DataFrame) -> DataFrame:
    """Index rows whose key starts with a fragment, for fragments of any length.

    A key has 24 digits, so longer fragments are cut; an empty one finds all.
    Fragments that aren't hexadecimal are an error.  There is one equi-join for
    each length that occurs, 25 at most.  A short fragment finds a large share of
    the index, so its matches are spread over as many tasks as a shuffle has."""
    bare = F.when(F.lower(F.substring("fragment", 1, len(X.PREFIX))) == X.PREFIX, F.substr("fragment", F.lit(len(X.PREFIX) + 1))).otherwise(F.col("fragment"))
    wanted = fragments.select("fragment", F.lower(F.substring(F.when(bare.rlike("^[0-9A-Fa-f]*$"), bare).otherwise(F.raise_error(F.lit("invalid id fragment"))), 1, 24)).alias("start"))
    lengths = sorted(r[0] for r in wanted.select(F.length("start").alias("n")).distinct().where("n is not null").collect())
    spread, found = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))), None
    for n in lengths:
        keys, asked = index.withColumn("start", F.substring("key", 1, n)), wanted.where(F.length("start") == n)
        on = ["start"]
        if n <= SHORT:
            keys = keys.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(spread)))
            asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
            on = ["start", "salt"]
        some = keys.join(asked, on).drop(*on)
        found = some if found is None else found.unionByName(some)
    found = index.join(wanted, F.lit(False)) if found is None else found
    return found.select("fragment", "key", "flags", *[c for c in ("silo", "offset") if c in index.columns])


def by_id_lines(found: DataFrame, records: DataFrame) -> DataFrame:
    """The record of each match, looked up by place: fragment, line."""
    heads = records.select("silo", "offset", "record_id", "warc_type")
    line = F.format_string("id %s wt %s", "record_id", "warc_type")
    return found.join(heads, ["silo", "offset"]).select("fragment", line.alias("line"))


def exit_status(found: DataFrame, always_ok: bool = False) -> DataFrame:
    """The number of matches as a status, 255 at most."""
    return found.agg(F.when(F.lit(always_ok), F.lit(0)).otherwise(F.least(F.count(F.lit(1)), F.lit(255))).cast("int").alias("status"))


def union_on_read(*parts: DataFrame) -> DataFrame:
    """The index as readers see it: sorted rows and those appended since."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filter_ids(candidates: DataFrame, index: DataFrame, mode: str = "missing", records: DataFrame | None = None) -> DataFrame:
    """Candidates without an index entry, with one, or all with a 0/1 flag.

    With ``records`` (id) the full id has to exist as well."""
    known = index.select("key").distinct() if records is None else records.select(F.lower("id").alias("key")).distinct()
    wanted = X.key_of(F.col("id")) if records is None else F.lower("id")
    rows = candidates.withColumn("__key", wanted)
    if mode == "flag":
        flagged = rows.join(known.withColumn("__hit", F.lit(1)), rows["__key"] == known["key"], "left")
        return flagged.select("pos", F.concat_ws(" ", F.coalesce("__hit", F.lit(0)), "line").alias("line"))
    kind = {"missing": "left_anti", "found": "left_semi"}[mode]
    return rows.join(known, rows["__key"] == known["key"], kind).select("pos", "line")


def get_objects(parts: DataFrame) -> DataFrame:
    """Objects put together from their segments in order, and verified.

    Bodies stream past a running digest; no object is held in one row."""
    stated = parts.groupBy("id").agg(F.min_by("sha", "number").alias("payload_digest"), F.min_by("length", "number").alias("stated_length"))
    whole = digest_objects(parts.select("id", "number", "body", F.lit(None).alias("gz"))).join(stated, "id")
    good = F.col("chained") & (F.col("digest") == F.col("payload_digest")) & (F.col("total_length") == F.col("stated_length"))
    return whole.select("id", F.col("n_segments").cast("long").alias("n_segments"), "total_length", "digest", good.alias("verified"))


def object_headers(parts: DataFrame) -> DataFrame:
    """The headers a reader sees: of a segmented object the first segment's, with
    the length and digest of the whole."""
    first = parts.groupBy("id").agg(F.sum("segment_length").alias("content_length"), F.count(F.lit(1)).alias("n_segments"), F.min_by("sha", "number").alias("sha"), F.min_by("content_type", "number").alias("content_type"), F.min_by("warc_type", "number").alias("warc_type"))
    headers = F.create_map(
        F.lit("WARC-Type"), F.col("warc_type"), F.lit("Content-Type"), F.col("content_type"), F.lit("Content-Length"), F.col("content_length").cast("string"),
        F.lit("WARC-Block-Digest"), F.concat(F.lit("sha256:"), F.col("sha")),
    )
    return first.select("id", "content_length", "n_segments", X.serialize_header(F.col("id"), headers).alias("header"))


def housekeep(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge the appendix into the sorted index: a set, ranged and sorted by key."""
    return base.unionByName(delta).distinct().repartitionByRange("key").sortWithinPartitions("key", "flags", "silo", "offset", "cont")


def bucket_directory(index: DataFrame, each: int = 250_000) -> DataFrame:
    """For each bucket the least difference of a record's place and its
    predicted place.

    Places come from counts by key range: a window over each range plus the
    records of the ranges below it, so no task sees the whole index.  Ranges are
    key prefixes, long enough for about ``each`` records (keys are digests, so
    ranges are even)."""
    n = index.count()
    digits = min(6, max(2, math.ceil(math.log(max(1.0, n / each), 16))))
    ranged = index.withColumn("span", F.substring("key", 1, digits))
    counts = ranged.groupBy("span").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("span", before.alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("records"))
    order = Window.partitionBy("span").orderBy("key", "flags", "silo", "offset", "cont")
    placed = ranged.withColumn("within", F.row_number().over(order) - 1).join(counts, "span")
    bits = X.bucket_bits(F.col("records"))
    place_ = (F.col("before") + F.col("within")).cast("long")
    bucket = F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") / F.pow(F.lit(2), 24 - bits)).cast("long")
    return placed.select(bucket.alias("bucket"), (place_ - X.predicted_place(F.col("key"), F.col("records"))).alias("diff")).groupBy("bucket").agg(F.min("diff").alias("least"), F.count(F.lit(1)).alias("records"))


def reindex(headers: DataFrame) -> DataFrame:
    """Index rows from record headers alone: flags from type and segment headers,
    cont from the next segment of the same origin."""
    order = Window.partitionBy("origin").orderBy("segment_number")
    number, total = F.col("segment_number"), F.col("segment_total")
    last = F.max("segment_number").over(Window.partitionBy("origin"))
    flags = F.when(number.isNull(), X.type_flag(F.col("warc_type"))).when(number == 1, X.type_flag(F.col("warc_type")).bitwiseOR(F.lit(X.SEGMENTED | X.FIRST))).when(number == last, X.SEGMENTED | X.LAST).otherwise(X.SEGMENTED)
    cont = F.coalesce(F.substring(F.lead("record_id").over(order), 1, 8), F.lit("00000000"))
    return headers.select(X.key_of(F.col("record_id")).alias("key"), flags.cast("int").alias("flags"), "silo", "offset", F.when(number.isNull(), "00000000").otherwise(cont).alias("cont"))


def audit_checks(records: DataFrame) -> DataFrame:
    """Every check that a record fails: block digest, length, identity."""
    body = F.col("body")
    is_ = X.digest_header(body)
    checks = F.array(
        F.when(F.col("block_digest").isNull(), F.struct(F.lit("digest missing").alias("problem"), F.lit(None).cast("string").alias("stated"), is_.alias("found")))
        .when(~F.col("block_digest").startswith("sha256:"), F.struct(F.lit("digest is not sha256").alias("problem"), F.col("block_digest").alias("stated"), is_.alias("found")))
        .when(F.col("block_digest") != is_, F.struct(F.lit("digest differs").alias("problem"), F.col("block_digest").alias("stated"), is_.alias("found"))),
        F.when(F.col("content_length") != F.octet_length(body).cast("string"), F.struct(F.lit("length differs").alias("problem"), F.col("content_length").alias("stated"), F.octet_length(body).cast("string").alias("found"))),
        F.when(F.col("record_id") != X.ident(body), F.struct(F.lit("record id differs").alias("problem"), F.col("record_id").alias("stated"), X.ident(body).alias("found"))),
    )
    return records.withColumn("problems", F.array_compact(checks))


def audit(records: DataFrame) -> DataFrame:
    """Good and bad records of each silo."""
    bad = F.size("problems") > 0
    return audit_checks(records).groupBy("silo").agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))


def audit_errors(records: DataFrame) -> DataFrame:
    found = audit_checks(records).select("seq", "silo", F.explode("problems").alias("p"))
    return found.select("seq", "silo", "p.problem", "p.stated", "p.found")


def audit_segments(parts: DataFrame) -> DataFrame:
    """Segmented objects: numbers without gaps, total length, whole digest."""
    seen = parts.groupBy("id").agg(F.max("number").alias("last"), F.count(F.lit(1)).alias("n"), F.max("n_segments").alias("expected"))
    return seen.join(get_objects(parts), "id").select("id", (F.col("last") == F.col("n")).alias("chained"), (F.col("n") == F.col("expected")).alias("complete"), "verified")


def snapshot_missing(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct digests of a manifest that the index lacks; empty files go."""
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    wanted = manifest.where(F.col("digest") != empty).groupBy("digest").agg(F.min("pos").alias("pos"))
    known = index.select("key").distinct()
    return wanted.join(known, F.substring(wanted.digest, 1, 24) == known.key, "left_anti").select("pos", "digest")


def snapshot_changed(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose stored id isn't their digest in the manifest."""
    return manifest.join(stored, "pos").where(F.substring("digest", 1, X.ID_SIZE) != F.col("id")).select("pos", "digest", "id")


def snapshot_report(target: str, mtree: str, changed: DataFrame, missing: DataFrame, time: int) -> DataFrame:
    """The snapshot's JSON report: one document, so one row."""
    def entries(rows: DataFrame, key: str, value: str) -> DataFrame:
        return rows.select(F.concat(F.lit('"'), F.col(key), F.lit('":"'), F.col(value), F.lit('"')).alias("e")).agg(F.array_join(F.array_sort(F.collect_list("e")), ",").alias("e"))

    a, b = entries(changed, "digest", "id").select(F.col("e").alias("c")), entries(missing, "digest", "error").select(F.col("e").alias("m"))
    rows = a.select("c", F.lit(1).alias("one")).join(b.select("m", F.lit(1).alias("one")), "one")
    body = F.concat(F.lit('["STOW3.0",{"changed":{'), "c", F.lit('},"missing":{'), "m", F.lit('},"mtree":"'), F.lit(mtree), F.lit('","target":"'), F.lit(target), F.lit(f'","time":{time}}}]'))
    return rows.select(body.alias("report"))


def backup_select(current: DataFrame, ledger: DataFrame, quota: int, now: float) -> DataFrame:
    """Files by bytes changed, then age, while their running size keeps the quota.

    One window orders all silos: a row a silo file of some gigabytes."""
    both = current.join(ledger, "fn", "full_outer").where(F.col("size").isNotNull())
    both = both.select("fn", "size", F.abs(F.col("size") - F.coalesce("last_sz", F.lit(0))).alias("changed"), (F.lit(now) - F.coalesce("last_tm", F.lit(0.0))).alias("age"))
    order = Window.orderBy(F.desc("changed"), F.desc("age"), "fn").rowsBetween(Window.unboundedPreceding, 0)
    running = both.where("changed > 0").withColumn("running", F.sum("size").over(order))
    return running.where(F.col("running") <= quota).select("fn", "size", "changed", "running")


def rebuild_headers(rows: DataFrame) -> DataFrame:
    """Header maps without obsolete fields; legacy records get the digest of
    their body as block digest and id."""
    gone = F.map_filter("headers", lambda k, v: ~F.lower(k).isin("content-length-gzip", "z", "warc-record-digest"))
    legacy = F.exists(F.map_keys("headers"), lambda k: F.lower(k) == "warc-record-digest")
    new = F.when(legacy, F.map_concat(F.map_filter(gone, lambda k, v: F.lower(k) != "warc-block-digest"), F.create_map(F.lit("WARC-Block-Digest"), X.digest_header(F.col("body"))))).otherwise(gone)
    return rows.withColumn("new_id", F.when(legacy, X.ident(F.col("body"))).otherwise(F.col("record_id"))).withColumn("new_headers", new)


#: Field names as they are written.
_NAMES = ("Content-Length", "Content-Type", "WARC-Block-Digest", "WARC-Date", "WARC-Filename", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length", "WARC-Type")


def proper_names(headers: Column) -> Column:
    """A header map with known field names in their usual case."""
    known = F.create_map(*[F.lit(x) for n in _NAMES for x in (n.lower(), n)])
    return F.transform_keys(headers, lambda k, _: F.coalesce(F.try_element_at(known, F.lower(k)), k))


def warcinfo_bodies(silos: DataFrame, title: str, fields: list[tuple[str, str]]) -> DataFrame:
    """(silo, body, id) of the warcinfo record of each silo; reserved field names
    in ``fields`` are dropped."""
    kept = [(n, v) for n, v in fields if n.lower() not in ("conformsto:", "format:", "software:", "title:")]
    lines = [f"title: {title} "] + [f"{n} {v}" for n, v in kept] + ["format: WARC File Format 1.1", "conformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/", "software: stratavault"]
    body = F.concat(F.lit(lines[0]), X.silo_path(F.col("silo")), F.lit("\r\n" + "".join(f"{x}\r\n" for x in lines[1:])))
    return silos.select("silo", body.alias("body")).withColumn("id", X.ident(F.col("body")))


def warcinfo(silos: DataFrame, title: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Silo, identity and length of each silo's warcinfo record."""
    return warcinfo_bodies(silos, title, fields).select("silo", "id", F.octet_length("body").cast("long").alias("length"))
