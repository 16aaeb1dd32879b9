"""The archive's query catalogue: each query over whole tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import archive as A
from ..operators import bytes_ops as B
from ..streaming import ingest as S

CAP = 4096
PER_SILO = 64


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as payloads."""
    return _t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("seq"), F.lit("resource").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("text").cast("binary").alias("payload"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").where("html is not null").select(F.col("page_id").alias("seq"), F.lit("resource").alias("warc_type"), F.lit("text/html").alias("content_type"), F.col("html").cast("binary").alias("payload"))


def label_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Labels as metadata of their document."""
    body = F.format_string('{"quality":%d,"toxic":%d}', "quality", "toxic")
    docs = A.identify(documents(spark, d)).select(F.col("seq").alias("doc_id"), F.col("id").alias("ref"))
    return _t(spark, d, "labels").where("quality is not null and toxic is not null").select("doc_id", body.alias("body")).join(docs, "doc_id")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(A.store_dedup(documents(spark, d)), CAP)


def index(spark: SparkSession, d: str) -> DataFrame:
    return A.index_rows(A.place(parts(spark, d), PER_SILO))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all documents, benchmark items and pages as lines to look up."""
    def rows(name: str, key: str, text: str, base: int) -> DataFrame:
        return _t(spark, d, name).where(f"{text} is not null").select((F.col(key) + base).alias("pos"), X.ident(F.col(text)).alias("id"))

    both = rows("documents", "doc_id", "text", 0).unionByName(rows("benchmark", "item_id", "text", 1 << 40)).unionByName(rows("pages", "page_id", "html", 1 << 41))
    return both.withColumn("line", X.with_prefix(F.col("id")))


_DOCS = "docs as (select doc_id as seq, text, sha256(text) as sha, cast(octet_length(encode(text)) as bigint) as length from documents where text is not null and text <> '')"
_OBJ = _DOCS + ", obj as (select substr(sha, 1, 32) as id, min(seq) as seq, any_value(text) as text, any_value(sha) as sha, any_value(length) as length from docs group by sha)"


def parts_sql(cap: int) -> str:
    """Objects of the documents cut at ``cap`` bytes, as CTEs up to ``parts``."""
    return _OBJ + f""", cut as (
  select *, cast(ceil(length / {cap}.0) as integer) as n, unnest(range(1, cast(ceil(length / {cap}.0) as integer) + 1)) as number from obj
), body as (
  select *, from_hex(substr(hex(encode(text)), cast(2 * {cap} * (number - 1) + 1 as bigint), 2 * {cap})) as body from cut
), seg as (
  select *, case when number = 1 then id else substr(sha256(body), 1, 32) end as segment_id, cast(octet_length(body) as bigint) as segment_length,
    cast(case when n = 1 then 4 when number = 1 then 52 when number = n then 80 else 16 end as integer) as flags from body
), parts as (
  select *, coalesce(substr(lead(segment_id) over (partition by id order by number), 1, 8), '00000000') as cont from seg
)"""


_PARTS = parts_sql(CAP)
_INDEX = _PARTS + f""", placed as (
  select *, cast(floor(seq / {PER_SILO}.0) as integer) as silo,
    cast(coalesce(sum(segment_length) over (partition by floor(seq / {PER_SILO}.0) order by seq, number rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from parts
), idx as (select substr(segment_id, 1, 24) as key, flags, silo, "offset", cont from placed)"""
_CAND = """, cand as (
  select doc_id as pos, substr(sha256(text), 1, 32) as id from documents where text is not null
  union all select item_id + 1099511627776, substr(sha256(text), 1, 32) from benchmark where text is not null
  union all select page_id + 2199023255552, substr(sha256(html), 1, 32) from pages where html is not null
), lines as (select pos, id, 'https://example.org/arc/' || id as line, substr(id, 1, 24) as key from cand)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("q01_ident_resource", f"with {_DOCS} select seq, 'https://example.org/arc/' || substr(sha, 1, 32) as record_id, 'sha256:' || sha as block_digest from docs")
def q01(spark, d):
    rows = A.identify(documents(spark, d))
    return rows.select("seq", X.with_prefix(F.col("id")).alias("record_id"), F.concat(F.lit("sha256:"), "sha").alias("block_digest"))


_META = f"""with {_DOCS}, meta as (
  select doc_id, '{{"quality":' || quality || ',"toxic":' || toxic || '}}' as body, substr(sha, 1, 32) as ref
  from labels join docs on doc_id = seq where quality is not null and toxic is not null)"""


@query("q02_ident_metadata", _META + " select doc_id, body, substr(sha256('<https://example.org/arc/' || ref || '>' || chr(10) || sha256(body) || chr(10)), 1, 32) as id from meta")
def q02(spark, d):
    return label_bodies(spark, d).select("doc_id", "body", X.ident_metadata(F.col("ref"), F.col("body")).alias("id"))


@query("q03_store_dedup", f"with {_OBJ} select id, seq, length from obj")
def q03(spark, d):
    return A.store_dedup(documents(spark, d)).select("id", "seq", "length")


@query("q04_duplicate_report", f"with {_DOCS} select substr(sha, 1, 32) as id, count(*) as copies, min(seq) as first_seq from docs group by 1")
def q04(spark, d):
    return A.duplicates(documents(spark, d))


@query("q05_segments", f"with {_PARTS} select id, cast(number as integer) as number, segment_id, segment_length, flags, cont from parts")
def q05(spark, d):
    return parts(spark, d).select("id", "number", "segment_id", "segment_length", "flags", "cont")


@query("q06_index_entries", f"with {_INDEX} select * from idx")
def q06(spark, d):
    return index(spark, d)


@query("q07_index_scan_by_type", f"""with {_INDEX} select key, flags, silo, "offset", cont from idx where flags = 4 and key like '0%'
  union all select key, flags, silo, "offset", cont from idx where flags = 4 and key like 'ab%' union all select key, flags, silo, "offset", cont from idx where flags = 4 and key like '0a%'""")
def q07(spark, d):
    return A.dump_index(index(spark, d), ["0", "AB", "0a"], X.RESOURCE)


_FRAG = ", frags as (select distinct substr(sha256(text), 1, 3) as fragment from benchmark where text is not null)"


@query("q08_by_id_prefix", f"with {_INDEX}{_FRAG} select fragment, key, flags from idx join frags on starts_with(key, fragment)")
def q08(spark, d):
    frags = _t(spark, d, "benchmark").where("text is not null").select(F.substring(X.digest(F.col("text")), 1, 3).alias("fragment")).distinct()
    return A.by_id(index(spark, d), frags).select("fragment", "key", "flags")


@query("q09_filter_missing", f"with {_INDEX}{_CAND} select pos, line from lines where not exists (select 1 from idx where idx.key = lines.key)")
def q09(spark, d):
    return A.filter_ids(candidates(spark, d), index(spark, d)).orderBy("pos")


@query("q10_filter_found", f"with {_INDEX}{_CAND} select pos, line from lines where exists (select 1 from idx where idx.key = lines.key)")
def q10(spark, d):
    return A.filter_ids(candidates(spark, d), index(spark, d), "found").orderBy("pos")


@query("q11_filter_flag", f"with {_INDEX}{_CAND} select pos, case when exists (select 1 from idx where idx.key = lines.key) then '1 ' else '0 ' end || line as line from lines")
def q11(spark, d):
    return A.filter_ids(candidates(spark, d), index(spark, d), "flag").orderBy("pos")


@query("q12_filter_verified", f"with {_OBJ}{_CAND} select pos, line from lines where exists (select 1 from obj where obj.id = lines.id)")
def q12(spark, d):
    return A.filter_ids(candidates(spark, d), index(spark, d), "found", A.store_dedup(documents(spark, d)).select("id"))


@query("q13_get_headers", f"""with {_OBJ} select id, length as content_length, cast(ceil(length / {CAP}.0) as bigint) as n_segments,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Record-ID: <https://example.org/arc/' || id || '>' || chr(13) || chr(10) || 'Content-Length: ' || length || chr(13) || chr(10)
  || 'Content-Type: text/plain' || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || chr(13) || chr(10) as header from obj""")
def q13(spark, d):
    return A.object_headers(parts(spark, d))


@query("q14_get_verify", f"with {_OBJ} select id, cast(ceil(length / {CAP}.0) as bigint) as n_segments, length as total_length, sha as digest, true as verified from obj")
def q14(spark, d):
    return A.get_objects(parts(spark, d))


@query("q15_housekeep", f"with {_INDEX} select distinct * from idx")
def q15(spark, d):
    rows = index(spark, d)
    return A.housekeep(rows.where("flags <> 4"), rows)


@query("q16_bucket_directory", f"""with {_INDEX}, r as (select key, row_number() over (order by key, flags, silo, "offset", cont) - 1 as place, count(*) over () as n, cast('0x' || substr(key, 1, 6) as bigint) as fraction from idx),
  b as (select *, greatest(14, cast(ceil(log2(greatest(n, 1))) as integer)) - 12 as bits from r)
  select cast(fraction // cast(pow(2, 24 - bits) as bigint) as bigint) as bucket, cast(min(place - (fraction * n) // 16777216) as bigint) as least, count(*) as records from b group by 1""")
def q16(spark, d):
    return A.bucket_directory(index(spark, d))


@query("q17_reindex_diff", f"with {_INDEX} select count(*) as records, cast(0 as bigint) as different from idx")
def q17(spark, d):
    placed = A.place(parts(spark, d), PER_SILO)
    several = F.col("n_segments") > 1
    headers = placed.select(F.col("segment_id").alias("record_id"), F.col("id").alias("origin"), F.when(several, F.col("number")).alias("segment_number"), F.when(F.col("number") == F.col("n_segments"), F.col("length")).alias("segment_total"), "warc_type", "silo", "offset")
    new, old = A.reindex(headers).withColumn("side", F.lit(1)), A.index_rows(placed).withColumn("side", F.lit(-1))
    sums = new.unionByName(old).groupBy("key", "flags", "silo", "offset", "cont").agg(F.sum("side").alias("s"), F.count_if(F.col("side") == -1).alias("n"))
    return sums.agg(F.sum("n").alias("records"), F.sum(F.abs("s")).cast("long").alias("different"))


def damaged(spark, d):
    """Stored records whose body was altered where doc_id % 97 = 0."""
    rows = A.store_dedup(documents(spark, d))
    body = F.when(F.col("seq") % 97 == 0, F.concat(F.col("payload"), F.lit("x").cast("binary"))).otherwise(F.col("payload"))
    return rows.select("seq", F.floor(F.col("seq") / PER_SILO).cast("int").alias("silo"), F.col("id").alias("record_id"), F.concat(F.lit("sha256:"), "sha").alias("block_digest"), F.col("length").cast("string").alias("content_length"), body.alias("body"))


@query("q18_audit_silo_counts", f"with {_OBJ} select cast(floor(seq / {PER_SILO}.0) as integer) as silo, count(*) filter (seq % 97 <> 0) as good, count(*) filter (seq % 97 = 0) as bad from obj group by 1")
def q18(spark, d):
    return A.audit(damaged(spark, d))


@query("q19_audit_errors", f"""with {_OBJ}, bad as (select seq, cast(floor(seq / {PER_SILO}.0) as integer) as silo, id, sha, length, sha256(text || 'x') as now from obj where seq % 97 = 0)
  select seq, silo, 'digest differs' as problem, 'sha256:' || sha as stated, 'sha256:' || now as found from bad
  union all select seq, silo, 'length differs', cast(length as varchar), cast(length + 1 as varchar) from bad
  union all select seq, silo, 'record id differs', id, substr(now, 1, 32) from bad""")
def q19(spark, d):
    return A.audit_errors(damaged(spark, d))


@query("q20_audit_segmented", f"with {_OBJ} select id, true as chained, true as complete, true as verified from obj where length > {CAP}")
def q20(spark, d):
    return A.audit_segments(parts(spark, d).where("n_segments > 1"))


@query("q21_silo_path", """select o_orderkey as silo, case when o_orderkey < 100 then '0/' when o_orderkey < 10000 then '1/' || lpad(cast(o_orderkey // 100 as varchar), 2, '0') || '/'
  when o_orderkey < 1000000 then '2/' || lpad(cast(o_orderkey // 10000 as varchar), 2, '0') || '/' || lpad(cast(o_orderkey // 100 % 100 as varchar), 2, '0') || '/'
  else '3/' || lpad(cast(o_orderkey // 1000000 as varchar), 2, '0') || '/' || lpad(cast(o_orderkey // 10000 % 100 as varchar), 2, '0') || '/' || lpad(cast(o_orderkey // 100 % 100 as varchar), 2, '0') || '/' end
  || lpad(cast(o_orderkey as varchar), 8, '0') || '.warc.gz' as path from orders""")
def q21(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("silo"), X.silo_path(F.col("o_orderkey")).alias("path"))


@query("q22_parse_size", """with s as (select p_partkey, p_size, case p_partkey % 5 when 0 then p_size || 'k' when 1 then p_size || ' MB' when 2 then p_size || '.5g' when 3 then p_size || 'x' else cast(p_size as varchar) end as text from part)
  select p_partkey, text, cast(case p_partkey % 5 when 0 then p_size * 1024.0 when 1 then p_size * 1048576.0 when 2 then (p_size + 0.5) * 1073741824.0 when 3 then null else p_size end as bigint) as bytes,
  case when p_partkey % 5 = 3 then 'invalid suffix' end as problem from s""")
def q22(spark, d):
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 5
    text = F.when(kind == 0, F.concat(size, F.lit("k"))).when(kind == 1, F.concat(size, F.lit(" MB"))).when(kind == 2, F.concat(size, F.lit(".5g"))).when(kind == 3, F.concat(size, F.lit("x"))).otherwise(size)
    rows = _t(spark, d, "part").select("p_partkey", text.alias("text"))
    value, problem = X.parse_size(F.col("text"))
    return rows.select("p_partkey", "text", value.alias("bytes"), problem.alias("problem"))


_WI = "'title: Test archive ' || path || chr(13) || chr(10) || 'operator: someone' || chr(13) || chr(10) || 'format: WARC File Format 1.1' || chr(13) || chr(10) || 'conformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/' || chr(13) || chr(10) || 'software: stratavault' || chr(13) || chr(10)"


@query("q23_warcinfo_rows", f"""with s as (select distinct cast(floor(doc_id / {PER_SILO}.0) as integer) as silo from documents where text is not null), p as (select silo, case when silo < 100 then '0/' else '1/' || lpad(cast(silo // 100 as varchar), 2, '0') || '/' end || lpad(cast(silo as varchar), 8, '0') || '.warc.gz' as path from s)
  select silo, substr(sha256({_WI}), 1, 32) as id, cast(octet_length(encode({_WI})) as bigint) as length from p""")
def q23(spark, d):
    silos = documents(spark, d).select(F.floor(F.col("seq") / PER_SILO).cast("int").alias("silo")).distinct()
    return A.warcinfo(silos, "Test archive", [("operator:", "someone"), ("format:", "ignored")])


@query("q24_id_validity", f"""with {_DOCS}, c as (select seq, case seq % 6 when 0 then substr(sha, 1, 32) when 1 then 'https://example.org/arc/' || substr(sha, 1, 32) when 2 then 'https://other.org/' || substr(sha, 1, 32) when 3 then substr(sha, 1, 31) || 'g' when 4 then substr(sha, 1, 20) else substr(sha, 1, 40) end as text from docs)
  select seq, text, case seq % 6 when 2 then 'wrong prefix' when 3 then 'not hexadecimal' when 4 then 'too short' when 5 then 'too long' end as problem from c""")
def q24(spark, d):
    rows = A.identify(documents(spark, d))
    kind, sha = F.col("seq") % 6, F.col("sha")
    text = F.when(kind == 0, F.col("id")).when(kind == 1, X.with_prefix(F.col("id"))).when(kind == 2, F.concat(F.lit("https://other.org/"), "id")).when(kind == 3, F.concat(F.substring(sha, 1, 31), F.lit("g"))).when(kind == 4, F.substring(sha, 1, 20)).otherwise(F.substring(sha, 1, 40))
    return rows.select("seq", text.alias("text")).withColumn("problem", X.id_problem(F.col("text")))


@query("q25_mime_allow", "select 'text/plain' as content_type, true as allowed, count(*) as n from documents where text is not null union all select 'text/html', false, count(*) from pages where html is not null")
def q25(spark, d):
    rows = documents(spark, d).unionByName(pages(spark, d))
    return rows.groupBy("content_type", X.mime_allowed(F.col("content_type"), ["application/octet-stream", "Text/Plain"]).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("q26_flags_decode", f"with {_PARTS} select flags, (flags & 16) <> 0 as segmented, (flags & 32) <> 0 as first, (flags & 64) <> 0 as last, count(*) as n from parts group by all")
def q26(spark, d):
    f = F.col("flags")
    return index(spark, d).groupBy("flags", X.has_flag(f, X.SEGMENTED).alias("segmented"), X.has_flag(f, X.FIRST).alias("first"), X.has_flag(f, X.LAST).alias("last")).agg(F.count(F.lit(1)).alias("n"))


@query("q27_metadata_by_referent", _META + " select ref, count(*) as n, min(doc_id) as first_doc from meta group by ref")
def q27(spark, d):
    heads = index(spark, d).where(X.has_flag(F.col("flags"), X.RESOURCE)).select("key").distinct()
    rows = label_bodies(spark, d)
    return rows.join(heads, X.key_of(rows.ref) == heads.key, "left_semi").groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def manifest(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("pos"), X.digest(F.coalesce("html", F.lit(""))).alias("digest")).unionByName(_t(spark, d, "documents").select((F.col("doc_id") + (1 << 40)).alias("pos"), X.digest(F.coalesce("text", F.lit(""))).alias("digest")))


@query("q28_snapshot_missing", """select min(page_id) as pos, sha256(html) as digest from pages where html is not null and html <> '' and substr(sha256(html), 1, 24) not in (select substr(sha256(text), 1, 24) from documents where text is not null) group by html""")
def q28(spark, d):
    return A.snapshot_missing(manifest(spark, d), index(spark, d))


_CHANGED = "select page_id as pos, sha256(html) as digest, substr(sha256(html || '!'), 1, 32) as id from pages where html is not null and page_id % 10 = 3"


def changed(spark, d):
    rows = _t(spark, d, "pages").where("html is not null")
    now = F.when(F.col("page_id") % 10 == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    return A.snapshot_changed(rows.select(F.col("page_id").alias("pos"), X.digest(F.col("html")).alias("digest")), rows.select(F.col("page_id").alias("pos"), X.ident(now).alias("id")))


@query("q29_snapshot_changed", _CHANGED)
def q29(spark, d):
    return changed(spark, d)


@query("q30_snapshot_report", f"""with c as ({_CHANGED}), m as (select sha256(text) as digest from benchmark where text is not null)
  select '["STOW3.0",{{"changed":{{' || (select coalesce(string_agg('"' || digest || '":"' || id || '"', ',' order by '"' || digest || '":"' || id || '"'), '') from c) || '}},"missing":{{'
  || (select coalesce(string_agg('"' || digest || '":"not found"', ',' order by digest), '') from m) || '}},"mtree":"00","target":"pages","time":1700000000}}]' as report""")
def q30(spark, d):
    missing = _t(spark, d, "benchmark").where("text is not null").select(X.digest(F.col("text")).alias("digest"), F.lit("not found").alias("error"))
    return A.snapshot_report("pages", "00", changed(spark, d), missing, 1_700_000_000)


@query("q31_backup_select", """with s as (select 'silo-' || s_suppkey as fn, cast(round(abs(s_acctbal) * 100) as bigint) as size, s_suppkey from supplier),
  l as (select fn, size // 2 as last_sz, cast(s_suppkey as double) as last_tm from s where s_suppkey % 3 = 0),
  b as (select s.fn, size, abs(size - coalesce(last_sz, 0)) as changed, 1000000.0 - coalesce(last_tm, 0) as age from s left join l using (fn)),
  r as (select *, cast(sum(size) over (order by changed desc, age desc, fn rows unbounded preceding) as bigint) as running from b where changed > 0)
  select fn, size, cast(changed as bigint) as changed, running from r where running <= 20000000""")
def q31(spark, d):
    rows = _t(spark, d, "supplier").select(F.concat(F.lit("silo-"), "s_suppkey").alias("fn"), F.round(F.abs("s_acctbal") * 100).cast("long").alias("size"), "s_suppkey")
    ledger = rows.where("s_suppkey % 3 = 0").select("fn", F.expr("size div 2").alias("last_sz"), F.col("s_suppkey").cast("double").alias("last_tm"))
    return A.backup_select(rows.select("fn", "size"), ledger, 20_000_000, 1_000_000.0)


@query("q32_test_bytes", """with recursive c(k, b) as (select 0, from_hex(repeat('00', 32)) union all select k + 1, from_hex(sha256(b)) from c where k < 31) select k as block, lower(hex(b)) as bytes from c""")
def q32(spark, d):
    return B.test_bytes(spark, 32 * 32)


_FIT = 15360


@query("q33_first_fit", f"""with recursive {_OBJ}, o as (select seq, length, seq // 50000 as shard, row_number() over (partition by seq // 50000 order by seq) as n from obj),
  f(shard, n, seq, length, silo, place, rooms) as (
    select distinct shard, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast([] as bigint[]) from o
    union all
    select shard, n, seq, length, case when length <= {_FIT} and p is not null then p - 1 else len(rooms) end,
      case when length <= {_FIT} and p is not null then {_FIT} - rooms[p] else 0 end,
      case when length > {_FIT} then list_concat(rooms, list_concat(list_transform(range(1, cast(ceil(length / {_FIT}.0) as bigint)), lambda x: cast(0 as bigint)), [ceil(length / {_FIT}.0)::bigint * {_FIT} - length]))
        when p is null then list_append(rooms, {_FIT} - length) else list_transform(rooms, lambda x, i: case when i = p then x - length else x end) end
    from (select o.shard, o.n, o.seq, o.length, f.rooms, nullif(list_position(list_transform(f.rooms, lambda x: x >= o.length), true), 0) as p from f join o on o.shard = f.shard and o.n = f.n + 1)
  ), g as (select *, unnest(range(1, cast(ceil(length / {_FIT}.0) as bigint) + 1)) as part from f where n > 0)
  select shard, seq, cast(part as integer) as part, cast(silo + part - 1 as integer) as silo, cast(case when part = 1 then place else 0 end as bigint) as "offset", cast(least({_FIT}, length - (part - 1) * {_FIT}) as bigint) as length from g""")
def q33(spark, d):
    objects = A.store_dedup(documents(spark, d)).select("seq", "length")
    return B.first_fit(objects, _FIT)


@query("q34_record_offsets", f'with {_INDEX} select id, cast(number as integer) as number, silo, "offset" from placed')
def q34(spark, d):
    return A.place(parts(spark, d), PER_SILO).select("id", "number", "silo", "offset")


@query("q35_rebuild_headers", f"""with {_OBJ} select seq, case when seq % 2 = 0 then id else substr(sha, 1, 32) end as new_id, case when seq % 2 = 0 then 'sha256:old' else 'sha256:' || sha end as block_digest, cast(2 as integer) as n_headers from obj""")
def q35(spark, d):
    rows = A.store_dedup(documents(spark, d))
    headers = F.map_from_arrays(
        F.when(F.col("seq") % 2 == 0, F.array(F.lit("Content-Length-GZIP"), F.lit("z"), F.lit("WARC-Block-Digest"), F.lit("WARC-Type"))).otherwise(F.array(F.lit("WARC-record-digest"), F.lit("Z"), F.lit("WARC-Block-Digest"), F.lit("WARC-Type"))),
        F.array(F.lit("1"), F.lit("zz"), F.lit("sha256:old"), F.lit("resource")),
    )
    old = F.when(F.col("seq") % 2 == 0, F.col("id")).otherwise(F.lit("legacy"))
    out = A.rebuild_headers(rows.select("seq", old.alias("record_id"), headers.alias("headers"), F.col("payload").alias("body")))
    return out.select("seq", "new_id", F.col("new_headers")["WARC-Block-Digest"].alias("block_digest"), F.size("new_headers").alias("n_headers"))


@query("q36_gzip_roundtrip", f"with {_OBJ} select id, length, true as same from obj")
def q36(spark, d):
    rows = A.store_dedup(documents(spark, d))
    return B.gzip_roundtrip(rows.select("id", "length", "payload"))


@query("q37_gzip_stitch", f"with {_OBJ} select id, sha as digest, true as single_member from obj where length > {CAP}")
def q37(spark, d):
    return B.stitch(parts(spark, d).where("n_segments > 1"))


@query("q38_ctr_cipher")
def q38(spark, d):
    return B.encrypt_rows(A.store_dedup(documents(spark, d)).select("id", "payload"), b"0123456789abcdef0123456789abcdef", b"signing key")


@query("q39_streaming_dedup", f"with {_OBJ} select id, cast(count(*) as bigint) as n from obj group by id")
def q39(spark, d):
    return S.stream_dedup(spark, f"{d}/documents.parquet").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("q40_conversations", """with c as (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as body from conversations where role is not null and text is not null group by conv_id) select conv_id, substr(sha256(body), 1, 32) as id from c""")
def q40(spark, d):
    rows = _t(spark, d, "conversations").where("role is not null and text is not null")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("t"))
    return turns.select("conv_id", X.ident(F.array_join(F.transform("t", lambda x: x["line"]), "\n")).alias("id"))


@query("q41_dump_lines", f"""with {_INDEX} select key || ' 0x' || lpad(lower(to_hex(flags)), 8, '0') || ' ' || lpad(cast(silo as varchar), 8, ' ') || ' ' || lpad(cast("offset" as varchar), 12, ' ') || ' ' || cont as line from idx""")
def q41(spark, d):
    return index(spark, d).select(A.dump_line().alias("line"))


FLAGSHIP = "q06_index_entries"

from . import physical  # noqa: E402, F401  (adds its queries)
