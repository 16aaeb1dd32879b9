"""Queries that go through silo files, text files and frames, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..archive import Archive
from ..functions import exprs as X
from ..operators import archive as A
from ..operators import backup as K
from ..operators import physical as P
from ..sources import text as T
from ..sources.config import ArchiveConfig, as_table
from ..sources.shared import new_folder
from ..streaming import ingest
from ..streaming import snapshot as S
from . import catalogue as C

MAX_SIZE, SEGMENT = 1 << 18, 1 << 14
DATE = "2024-01-01T00:00:00Z"
_PARTS = C.parts_sql(SEGMENT)
_built: dict[tuple[str, str], Archive] = {}


def archive(spark: SparkSession, d: str) -> Archive:
    """The documents, and the labels as their metadata, stored in silos below the
    shared folder, once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        made = Archive(spark, ArchiveConfig(prefix=X.PREFIX, directory=new_folder(spark, "archive") + "/", max_size=MAX_SIZE, segment_size=SEGMENT), DATE)
        made.store(C.documents(spark, d).where("octet_length(payload) > 0").select("seq", "payload", "content_type"))
        made.housekeeping()
        made.store(labels(spark, d), "metadata")
        _built[key] = made
    return _built[key]


def labels(spark: SparkSession, d: str) -> DataFrame:
    return C.label_bodies(spark, d).select(F.col("doc_id").alias("seq"), F.col("body").cast("binary").alias("payload"), F.col("ref").alias("refers_to"))


_META = C._META + ", m as (select substr(sha256('<https://example.org/arc/' || ref || '>' || chr(10) || sha256(body) || chr(10)), 1, 32) as id from meta group by all)"
_RECORDS = f"with {_PARTS}" + _META.removeprefix(f"with {C._DOCS}")


@C.query("q42_store_index", _RECORDS + " select substr(segment_id, 1, 24) as key, flags, cont from parts union all select substr(id, 1, 24), 8, '00000000' from m")
def q42(spark, d):
    return archive(spark, d).index().where(F.col("flags") != X.WARCINFO).select("key", "flags", "cont")


@C.query("q43_get_objects", f"""with {_PARTS}, o as (select id, cast(max(number) as integer) as n_segments, any_value(length) as total_length, any_value(sha) as digest from parts group by id){C._CAND}
  select pos, lines.id, n_segments, total_length, digest, o.id is not null as verified, case when o.id is null then 'ID not found' end as problem from lines left join o on o.id = lines.id""")
def q43(spark, d):
    found = archive(spark, d).get(C.candidates(spark, d).select("pos", "id"))
    return found.select("pos", "id", "n_segments", "total_length", "digest", "verified", "problem")


@C.query("q44_get_problems", f"""with {_PARTS} select segment_id as id, 'ID is continuation segment' as problem from parts where number > 1 and segment_id not in (select id from obj)""")
def q44(spark, d):
    a = archive(spark, d)
    ids = a.records().where("segment_number is not null").select(F.xxhash64("silo", "offset").alias("pos"), F.col("record_id").alias("id"))
    return a.get(ids).where("problem is not null").select("id", "problem")


@C.query("q45_audit_silos", _RECORDS + " select cast((select count(*) from parts) + (select count(*) from m) as bigint) as good, cast(0 as bigint) as bad")
def q45(spark, d):
    a = archive(spark, d)
    return P.audit_silos(a.records(body=True).where("warc_type <> 'warcinfo'")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def damaged(spark, d):
    """Records read from silos; some bodies are altered and some headers wrong."""
    rows = archive(spark, d).records(body=True).where("warc_type <> 'warcinfo'")
    kind = F.conv(F.substring("record_id", 1, 2), 16, 10).cast("int")
    return rows.withColumns({
        "body": F.when(kind < 16, F.concat("body", F.lit(b"x"))).otherwise(F.col("body")),
        "block_digest": F.when(kind.between(16, 31), F.lit(None)).when(kind.between(32, 47), F.lit("sha1:00")).otherwise(F.col("block_digest")),
        "content_length": F.when(kind.between(48, 63), F.concat(F.lit("0"), "content_length")).otherwise(F.col("content_length")),
        "segment_number": F.when(kind.between(64, 79) & F.col("segment_number").isNotNull(), F.lit("two")).otherwise(F.col("segment_number")),
    })


@C.query("q46_audit_report", _RECORDS + """, r as (select segment_id as id, n > 1 as cut, number, true as resource from parts union all select id, false, 1, false from m),
  k as (select *, cast('0x' || substr(id, 1, 2) as integer) as kind from r), b as (
  select id, 'WARC-Block-Digest difference' as problem from k where kind < 16 union all select id, 'WARC-Block-Digest missing' from k where kind between 16 and 31
  union all select id, 'WARC-Block-Digest is not sha256' from k where kind between 32 and 47 union all select id, 'Content-Length difference' from k where kind < 16 or kind between 48 and 63
  union all select id, 'Bad WARC-Segment-Number' from k where cut and kind between 64 and 79
  union all select id, 'WARC-Record-ID difference' from k where kind < 16 and not (cut and number = 1) or cut and number = 1 and kind between 64 and 79)
  select id as record_id, problem from b""")
def q46(spark, d):
    return P.audit_report(damaged(spark, d)).select("record_id", "problem")


@C.query("q47_audit_objects", f"""with {_PARTS}, o as (select id, max(number) as n, any_value(length) as length from parts where n > 1 group by id)
  select id, cast(case when substr(id, 1, 1) in ('0', '1', '2', '3') then n - 1 else n end as integer) as n_segments, case when substr(id, 1, 1) in ('0', '1', '2', '3') then 'Failed to find segment ' || n when substr(id, 1, 1) in ('4', '5', '6', '7') then 'WARC-Segment-Total-Length difference' else '' end as problems from o""")
def q47(spark, d):
    rows = archive(spark, d).records(body=True)
    head = F.substring(P.origin_of(F.col("record_id"), F.col("segment_number"), F.col("segment_origin_id")), 1, 1)
    last = F.col("segment_total_length").isNotNull()
    rows = rows.where(~(last & head.isin(*"0123")) | F.col("segment_number").isNull())
    rows = rows.withColumn("segment_total_length", F.when(last & head.isin(*"4567"), F.concat("segment_total_length", F.lit("0"))).otherwise(F.col("segment_total_length")))
    return P.audit_objects(rows).select("id", "n_segments", F.array_join("problems", "; ").alias("problems"))


@C.query("q48_leftover_segments", f"with {_PARTS} select id, cast(number as bigint) as segment_number from parts where n > 1 and number > 1")
def q48(spark, d):
    rows = archive(spark, d).records().where("segment_number is null or segment_number <> '1'")
    return P.leftovers(rows).select("id", "segment_number")


@C.query("q49_reindex_silos", _RECORDS + " select cast((select count(*) from parts) + (select count(*) from m) as bigint) as records, cast(0 as bigint) as different, cast(0 as bigint) as unmatched")
def q49(spark, d):
    a = archive(spark, d)
    new, old = a.reindex(), a.index()
    both = new.select("key", "flags", "silo", "offset", "cont", F.lit(1).alias("side")).unionByName(old.select("*", F.lit(-1).alias("side")))
    sums = both.groupBy("key", "flags", "silo", "offset", "cont").agg(F.abs(F.sum("side")).alias("d"))
    counts = new.where(F.col("flags") != X.WARCINFO).agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("matched")).alias("unmatched"))
    return counts.join(sums.agg(F.sum("d").cast("long").alias("different")))


@C.query("q50_rematch", f"with {_PARTS} select substr(segment_id, 1, 24) as key, cont, true as matched from parts where n > 1 and number = 1")
def q50(spark, d):
    a = archive(spark, d)
    heads = a.records().where("segment_number = '1'")
    return P.rematch(P.reindex(heads), a.index()).select("key", "cont", "matched")


@C.query("q51_rebuild", _RECORDS + " select cast((select count(*) from parts) + (select count(*) from m) as bigint) as records, cast(0 as bigint) as changed")
def q51(spark, d):
    a = archive(spark, d)
    out = new_folder(spark, "rebuilt")
    a.rebuild(out)
    new = Archive(spark, ArchiveConfig(prefix=X.PREFIX, directory=out + "/", max_size=MAX_SIZE, segment_size=SEGMENT), DATE)
    columns = ["silo", "record_id", "warc_type", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", "refers_to", "segment_number", "segment_origin_id", "segment_total_length", F.sha2("body", 256).alias("sha")]
    old, now = (x.records(body=True).where("warc_type <> 'warcinfo'").select(*columns) for x in (a, new))
    gone = old.unionByName(now).groupBy(*old.columns).agg(F.count(F.lit(1)).alias("n")).where("n <> 2").agg(F.count(F.lit(1)).alias("changed"))
    return now.agg(F.count(F.lit(1)).alias("records")).join(gone)


@C.query("q52_by_id_lines", f"""with {_PARTS}, frags as (select distinct substr(sha256(text), 1, 3) as fragment from benchmark where text is not null union all select distinct substr(sha256(text), 1, 32) from documents where doc_id % 100 = 1 and text <> '' union all select 'F')
  select fragment, 'id ' || segment_id || ' wt ' || case when number = 1 then 'resource' else 'continuation' end as line from parts join frags on starts_with(segment_id, lower(fragment))""")
def q52(spark, d):
    short = C._t(spark, d, "benchmark").where("text is not null").select(F.substring(X.digest(F.col("text")), 1, 3).alias("fragment")).distinct()
    whole = C._t(spark, d, "documents").where("doc_id % 100 = 1 and text <> ''").select(X.ident(F.col("text")).alias("fragment")).distinct()
    one = spark.range(1).select(F.lit("F").alias("fragment"))
    a = archive(spark, d)
    found = A.by_id(a.index().where((F.col("flags") != X.METADATA) & (F.col("flags") != X.WARCINFO)), short.unionByName(whole).unionByName(one))
    return A.by_id_lines(found, a.records())


@C.query("q53_by_id_status", f"with {_PARTS} select cast(least(count(*), 255) as integer) as status from parts where segment_id like 'a%'")
def q53(spark, d):
    index = archive(spark, d).index().where((F.col("flags") != X.METADATA) & (F.col("flags") != X.WARCINFO))
    return A.exit_status(A.by_id(index, spark.range(1).select(F.lit("a").alias("fragment"))))


@C.query("q54_cgi_responses", f"""with {_PARTS}, o as (select id, max(number) as n, any_value(length) as length from parts group by id){C._CAND}
  select pos, case when o.id is null then 'Content-Type: text/html' || chr(10) || 'Status: 501 Error' || chr(10) || chr(10) || '<html><pre>ID not found' || chr(10) || '</pre></html>'
    else 'Content-Type: text/plain' || chr(10) || 'Content-Length: ' || length || chr(10) || 'Status: 200' || chr(10) || chr(10) end as response from lines left join o on o.id = lines.id where pos % 3 = 0""")
def q54(spark, d):
    ids = C.candidates(spark, d).where("pos % 3 = 0")
    return archive(spark, d).serve(ids.select("pos", F.concat(F.lit("/"), "id").alias("path_info"), F.lit("deflate").alias("accept_encoding")))


@C.query("q55_get_gzip", f"with {_PARTS} select id, cast(max(number) as bigint) as members, any_value(sha) as digest from parts group by id")
def q55(spark, d):
    a = archive(spark, d)
    ids = C.documents(spark, d).select(X.ident(F.col("payload")).alias("id")).where("length(id) > 0").distinct()
    parts = a.bodies(ids.select(F.xxhash64("id").alias("pos"), "id"), gzip=True).where("body is not null")
    whole = P.digest_objects(parts.select("id", "number", "body", F.lit(0).alias("gz")), packed=True)
    return whole.where("chained").select("id", F.col("n_segments").cast("long").alias("members"), "digest")


@C.query("q56_id_list_filter", f"with {_PARTS}{C._CAND} select line || ' extra' as line from lines where not exists (select 1 from parts where substr(segment_id, 1, 24) = lines.key)")
def q56(spark, d):
    folder = new_folder(spark, "ids")
    C.candidates(spark, d).select(F.concat("line", F.lit(" extra")).alias("line")).write.text(folder)
    out = new_folder(spark, "missing")
    archive(spark, d).filter(T.id_list(spark, [folder]), out=out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@C.query("q57_frames", """with f as (select doc_id as seq, cast(doc_id % 4 as integer) as cmd, text from documents where text is not null) select seq, cmd, sha256(case seq % 3 when 0 then '' when 1 then substr(sha256(text), 1, 32) else text end) as digest from f""")
def q57(spark, d):
    rows = C._t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 4).cast("int").alias("cmd"), "text")
    payload = F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, F.substring(X.digest(F.col("text")), 1, 32)).otherwise(F.col("text")).cast("binary")
    # a stream a row, so that each frame is known by its stream's name
    sent = rows.select(F.col("seq").cast("string").alias("stream"), T.frame(F.col("cmd"), payload).alias("content"))
    return T.frames(sent).select(F.col("stream").cast("long").alias("seq"), "cmd", F.sha2("payload", 256).alias("digest"))


_ASKED = "a as (select doc_id as seq, sha256(text) as digest from documents where text is not null union all select page_id + 1099511627776, sha256(html) from pages where html is not null)"


@C.query("q58_snapshot_replies", f"""with {_PARTS}, {_ASKED}, b as (select *, (row_number() over (order by seq) - 1) // 100 as part, exists (select 1 from parts where substr(segment_id, 1, 24) = substr(digest, 1, 24)) as there from a)
  select cast(part as integer) as part, digest as payload from b where not there union all select cast(part as integer), lpad(lower(to_hex(count(*))), 8, '0') from b group by part having bool_and(there)""")
def q58(spark, d):
    docs = C._t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("seq"), X.digest(F.col("text")).alias("digest"))
    pages = C._t(spark, d, "pages").where("html is not null").select((F.col("page_id") + (1 << 40)).alias("seq"), X.digest(F.col("html")).alias("digest"))
    frames = docs.unionByName(pages).select(F.lit("one").alias("stream"), "seq", F.lit(S.FILTER).alias("cmd"), F.unhex("digest").alias("payload"))
    return S.replies(frames, archive(spark, d).index(), 100).select("part", F.lower(F.hex("payload")).alias("payload"))


@C.query("q59_snapshot_metadata", """select cast(conv_id as varchar) as stream, string_agg(text, '' order by turn) as body from conversations where text is not null and text <> '' group by conv_id""")
def q59(spark, d):
    turns = C._t(spark, d, "conversations").where("text is not null and text <> ''").select(F.col("conv_id").cast("string").alias("stream"), (F.col("turn") + 1).alias("seq"), F.lit(S.META).alias("cmd"), F.col("text").cast("binary").alias("payload"))
    ends = turns.groupBy("stream").agg(F.max("seq").alias("seq"))
    head = ends.select("stream", F.lit(-1).cast("long").alias("seq"), F.lit(S.META).alias("cmd"), F.concat(F.lit("ref-"), "stream").cast("binary").alias("payload"))
    end = ends.select("stream", (F.col("seq") + 1).alias("seq"), F.lit(S.META).alias("cmd"), F.lit(b"").alias("payload"))
    found = S.metadata_sent(turns.unionByName(head).unionByName(end)).where("refers_to = concat('ref-', stream)")
    return found.select("stream", F.decode("payload", "UTF-8").alias("body"))


@C.query("q60_manifest", """select 'top/d' || (page_id % 3) as dirname, 'f' || page_id || 'é' as filename, sha256(html) as digest from pages where html is not null and html <> ''""")
def q60(spark, d):
    rows = C._t(spark, d, "pages").where("html is not null").select((F.col("page_id") % 3).alias("d"), F.col("page_id").alias("n"), X.digest(F.col("html")).alias("digest"))
    entry = F.concat(F.lit("    f"), "n", F.lit("\\303\\251 size=1 \\\n"), F.lit("        sha256digest="), "digest", F.lit("\n"))
    folders = rows.groupBy("d").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("files"))
    text = F.concat(F.lit("#mtree v2\n/set type=file uid=0\ntop type=dir\nd"), "d", F.lit(" type=dir\n    l type=link\n"), "files", F.lit("..\n..\n"))
    out = new_folder(spark, "manifests")
    folders.select(text.alias("value")).repartition(1).write.option("lineSep", "\n").text(out)
    return T.manifests(spark, f"{out}/*.txt").select("dirname", "filename", "digest")


@C.query("q61_index_order", "select cast(0 as bigint) as misplaced")
def q61(spark, d):
    out = new_folder(spark, "sorted")
    A.housekeep(archive(spark, d).index(), C.index(spark, d)).write.parquet(out)
    return P.out_of_order(spark.read.parquet(out)).agg(F.count(F.lit(1)).alias("misplaced"))


def _secrets(_: str) -> tuple[bytes, bytes]:
    return b"0123456789abcdef0123456789abcdef", b"signing key"


@C.query("q62_backup")
def q62(spark, d):
    out = new_folder(spark, "backup")
    return K.backup(spark, archive(spark, d).root, f"{out}/files", f"{out}/ledger", 1 << 40, 1_700_000_000.0, _secrets)


@C.query("q63_header_functions", f"""with {C._DOCS} select seq, case seq % 4 when 0 then length when 1 then 0 else -1 end as number, 16 + len(cast(length as varchar)) as field_length, substr(sha, 1, 8) || '00000000' as padded, seq % 2 = 0 as gzip from docs""")
def q63(spark, d):
    rows = A.identify(C.documents(spark, d))
    kind, length = F.col("seq") % 4, F.col("length").cast("string")
    text = F.when(kind == 0, length).when(kind == 1, F.lit("")).when(kind == 2, F.concat(length, F.lit("x"))).otherwise(F.concat(F.lit("-"), length))
    headers = F.create_map(F.lit("Content-Length"), F.lit("0"))
    value = X.header_value(X.header_set(headers, "content-length", text), "CONTENT-LENGTH")
    accept = F.when(F.col("seq") % 2 == 0, "br, gzip").otherwise("br")
    return rows.select("seq", X.header_number(value).alias("number"), (X.header_length(F.lit("Content-Length"), length) - 2).cast("long").alias("field_length"), F.lower(F.hex(X.key_bytes(F.substring("sha", 1, 8), 8))).alias("padded"), X.wants_gzip(accept).alias("gzip"))


def _other(spark: SparkSession, label: str) -> Archive:
    return Archive(spark, ArchiveConfig(prefix=X.PREFIX, directory=new_folder(spark, label) + "/", max_size=MAX_SIZE, segment_size=SEGMENT), DATE)


@C.query("q64_stream_store", f"with {_PARTS} select substr(segment_id, 1, 24) as key, flags, cont from parts")
def q64(spark, d):
    source = new_folder(spark, "incoming")
    n = ingest.spread(C.documents(spark, d).where("octet_length(payload) > 0").select("seq", "payload"), source)
    made = _other(spark, "streamed")
    ingest.stream_store(made, source, files_each=-(-n // 3))  # three micro-batches, of as many files as the rows need
    return made.index().where(F.col("flags") != X.WARCINFO).select("key", "flags", "cont")


@C.query("q65_snapshot", """with p as (select distinct sha256(html) as digest from pages where html is not null and html <> ''),
  m as (select sha256(string_agg(line, chr(10) order by line)) as digest from (select 'd/p' || page_id || ' sha256digest=' || sha256(html) as line from pages where html is not null and html <> '') having count(*) > 0)
  select substr(digest, 1, 24) as key from p union all select substr(digest, 1, 24) from m""")
def q65(spark, d):
    made = _other(spark, "snapshot")
    rows = C._t(spark, d, "pages").where("html is not null").select(F.lit("d").alias("dirname"), F.concat(F.lit("p"), "page_id").alias("filename"), F.col("html").cast("binary").alias("content"))
    made.snapshot("pages", rows, 1_700_000_000)
    heads = made.index().where(X.has_flag(F.col("flags"), X.RESOURCE))
    return heads.select("key")


@C.query("q66_folder_listing", """select 'sub/f=' || item_id as dirname, sha256(text || chr(10)) as digest from benchmark where text is not null and item_id is not null and item_id <> 1""")
def q66(spark, d):
    out = new_folder(spark, "folder")
    rows = C._t(spark, d, "benchmark").where("text is not null and item_id is not null").select(F.col("item_id").alias("f"), "text")
    rows.repartition("f").write.partitionBy("f").text(f"{out}/sub")
    return T.listing(spark, out, "^sub/f=1/").select("dirname", "digest")


@C.query("q67_config_table", """select r_name as section, cast(row_number() over (partition by r_regionkey order by n_nationkey) - 1 as integer) as pos, 'nation' || n_nationkey as name, case when n_nationkey % 2 = 0 then n_name end as arg from nation join region on n_regionkey = r_regionkey""")
def q67(spark, d):
    rows = C._t(spark, d, "nation").join(C._t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_regionkey", "n_nationkey")
    text, section = "# nations by region\n", None
    for r in rows.select("r_name", "n_nationkey", "n_name").toLocalIterator():  # a configuration is one text; there are 25 nations
        text += "" if r["r_name"] == section else f"{r['r_name']}:\n"
        section = r["r_name"]
        text += f"\tnation{r['n_nationkey']}" + (f" {r['n_name']}  # even\n" if r["n_nationkey"] % 2 == 0 else "\n")
    return as_table(spark, text)


@C.query("q68_files_sent", f"""select doc_id as seq, substr(sha256(text), 1, {X.ID_SIZE}) as id from documents where text <> '' and doc_id % 4 = 2""")
def q68(spark, d):
    rows = C._t(spark, d, "documents").where("text is not null")
    sent = rows.select(F.col("doc_id").cast("string").alias("stream"), T.frame((F.col("doc_id") % 4).cast("int"), F.col("text").cast("binary")).alias("content"))
    return S.files_sent(T.frames(sent)).select(F.col("stream").cast("long").alias("seq"), X.ident(F.col("payload")).alias("id"))


@C.query("q69_line_assembly", r"""with l as (select doc_id, list_filter(regexp_split_to_array(replace(text, ' ', case when doc_id % 2 = 0 then chr(13) else chr(13) || chr(10) end), '[\r\n]'), lambda x: x <> '') as lines from documents where text is not null)
  select doc_id, len(lines) as n_lines, sha256(array_to_string(lines, '|')) as digest from l""")
def q69(spark, d):
    ends = F.when(F.col("doc_id") % 2 == 0, "\r").otherwise("\r\n")
    rows = C._t(spark, d, "documents").where("text is not null").select("doc_id", T.assemble(F.replace("text", F.lit(" "), ends)).alias("lines"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "|"), 256).alias("digest"))
