"""An archive in a folder: its commands as functions of DataFrames.

Below ``config.directory`` lie the silos in their level folders; the index is
two Parquet tables, ``index/sorted`` and ``index/appendix/<batch>``.  The silos
alone define the archive: index rows always come from reading their headers."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import archive as A
from .operators import physical as P
from .sources import files, silo
from .sources.config import ArchiveConfig

KEY = "key string, flags int, silo int, offset long, cont string"


class Archive:
    """Commands on one archive.  The session needs the archive's folder to be
    reachable from all executors."""

    def __init__(self, spark: SparkSession, config: ArchiveConfig, date: str | None = None):
        self.spark, self.config = spark, config
        self.root = config.directory.rstrip("/")
        self.date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        silo.register(spark)

    # --- reading

    def records(self, body: bool = False, lenient: bool = False, raw: bool = False, silos: list[int] | None = None) -> DataFrame:
        """All records, or those of some silos."""
        reader = self.spark.read.format("silo").option("body", str(body).lower()).option("lenient", str(lenient).lower()).option("raw", str(raw).lower())
        if silos is not None:
            reader = reader.option("silo", ",".join(map(str, silos)))
        return reader.load(self.root)

    def index(self) -> DataFrame:
        """Sorted rows and the appendix together."""
        base = "sorted" if files.exists(f"{self.root}/index/sorted") else "previous"  # while housekeeping moves them
        parts = [self.spark.read.schema(KEY).parquet(p) for p in (f"{self.root}/index/{base}", f"{self.root}/index/appendix/*") if self._some(p)]
        return A.union_on_read(*parts) if parts else self.spark.createDataFrame([], KEY)

    def _indexed(self) -> bool:
        return any(self._some(f"{self.root}/index/{x}") for x in ("sorted", "previous", "appendix/*"))

    def _some(self, path: str) -> bool:
        return bool(files.listed(path.removesuffix("/*"), ".parquet"))

    # --- writing

    def store(self, payloads: DataFrame, warc_type: str = "resource", mime_type: str | None = None) -> DataFrame:
        """Store (seq, payload, and optionally content_type, refers_to, forced_id);
        the rows (seq, id) of all payloads, stored now or there before.

        Metadata need ``refers_to``, resources mustn't have it or ``forced_id``;
        the referent has to be there.  Empty payloads are an error."""
        has = set(payloads.columns)
        if warc_type not in ("resource", "metadata"):
            raise ValueError("illegal record type")
        if warc_type == "resource" and has & {"refers_to", "forced_id"}:
            raise ValueError("only metadata take a reference or an id")
        if warc_type == "metadata" and "refers_to" not in has:
            raise ValueError("metadata need a reference")
        default = mime_type or ("application/octet-stream" if warc_type == "resource" else "text/plain")
        kind = F.coalesce("content_type", F.lit(default)) if "content_type" in has else F.lit(default)
        allowed = self.config.resource_types if warc_type == "resource" else self.config.metadata_types
        rows = payloads.select(*[c for c in payloads.columns if c not in ("content_type", "warc_type")], F.lit(warc_type).alias("warc_type"), kind.alias("content_type"))
        refused = F.raise_error(F.concat(F.lit("illegal mime-type "), "content_type")).cast("boolean")
        rows = rows.where(F.when(X.mime_allowed(F.col("content_type"), list(allowed)), F.lit(True)).otherwise(refused))
        present = self.index()
        if warc_type == "metadata":
            bare = F.coalesce(X.bare_id(F.concat(F.lit("<"), "refers_to", F.lit(">"))), F.col("refers_to"))
            heads = present.where(X.has_flag(F.col("flags"), X.RESOURCE | X.METADATA)).select("key").distinct()
            known = rows.join(heads.withColumn("there", F.lit(True)), X.key_of(bare) == F.col("key"), "left").drop("key")
            rows = known.where(F.when(F.col("there"), F.lit(True)).otherwise(F.raise_error(F.lit("Referenced (-r) ID does not exist")).cast("boolean"))).drop("there")
        ids = A.identify(rows, strict=True).select("seq", "id")
        new = A.store_dedup(rows, present if self._indexed() else None, strict=True)
        cap = self.config.segment_size or max(1024, self.config.max_size // 4)
        self._add(P.encode_records(P.record_headers(A.segments(new, cap), self.date)))
        return ids

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        """A written intermediate, removed by ``_drop``."""
        path = f"{self.root}/tmp/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self) -> None:
        system, path = files.split(f"{self.root}/tmp")
        if files.exists(f"{self.root}/tmp"):
            system.delete_dir(path)

    def next_silo(self) -> int:
        return max([silo.silo_number(p) for p, *_ in files.listed(self.root, ".warc.gz")], default=-1) + 1

    def _add(self, encoded: DataFrame) -> None:
        """Write encoded records (seq, number, record, size) to new silos and
        their index rows to the appendix.

        Records are encoded once and written as they come; places and sizes alone
        are put in order, and the first place of each silo says where a record
        belongs, so a record moves once, to the task that writes its silo."""
        try:
            rows = self._table(encoded.withColumn("tie", F.xxhash64("record")), "records")
            largest = rows.agg(F.max("size")).first()[0]
            if largest is None:
                return
            first, info = self.next_silo(), 2048
            width = self.config.max_size - largest - info
            if width <= 0:
                raise ValueError("silo.max_size is too small for the largest record")
            ranged = rows.select(*P.ORDER, "size").repartitionByRange(*P.ORDER).sortWithinPartitions(*P.ORDER)
            placed = P.place_by_size(self._table(ranged.withColumn("uid", F.monotonically_increasing_id()), "places"), width, first)
            starts = [(r["silo"], *r["at"]) for r in placed.groupBy("silo").agg(F.min(F.struct(*P.ORDER)).alias("at")).collect()]  # a row a silo written
            numbers = sorted(s[0] for s in starts)
            info_rows = self._warcinfo(self.spark.createDataFrame([(n,) for n in numbers], "silo int"))
            out = info_rows.unionByName(P.in_silos(rows, starts).select("silo", F.lit(0).cast("long").alias("nth"), *P.ORDER, "record"), allowMissingColumns=True)
            P.clustered(out, "silo", "nth", *P.ORDER).select("silo", "record").write.format("silo").mode("append").option("basename", self.config.basename.replace("%08u", "%08d")).save(self.root)
            self._append(P.reindex(self.records(silos=numbers)).drop("matched"))
        finally:
            self._drop()

    def _warcinfo(self, silos: DataFrame) -> DataFrame:
        bodies = A.warcinfo_bodies(silos, self.config.title, list(self.config.warcinfo))
        encoded = P.encode_records(P.warcinfo_headers(bodies, self.date))
        return encoded.select(F.col("seq").cast("int").alias("silo"), F.lit(-1).cast("long").alias("nth"), "record")

    def _append(self, rows: DataFrame) -> None:
        rows.select("key", "flags", "silo", "offset", "cont").write.parquet(f"{self.root}/index/appendix/{uuid.uuid4().hex}")

    def make_silo(self, number: int) -> None:
        """A silo with its warcinfo record only; fails if it is there."""
        one = self.spark.createDataFrame([(number,)], "silo int")
        self._warcinfo(one).coalesce(1).select("silo", "record").write.format("silo").mode("append").save(self.root)

    def append_to(self, number: int, payloads: DataFrame) -> None:
        """Add small resources to an existing silo, if they fit."""
        new = A.store_dedup(payloads.withColumns({"warc_type": F.lit("resource"), "content_type": F.lit("application/octet-stream")}), self.index(), strict=True)
        try:
            rows = self._table(P.encode_records(P.record_headers(A.segments(new, self.config.max_size), self.date)), "append")
            before = [r for r in files.listed(self.root, ".warc.gz") if silo.silo_number(r[0]) == number]
            more = rows.agg(F.sum("size")).first()[0] or 0
            if not before or before[0][1] + more > self.config.max_size:
                raise ValueError("no such silo, or it would grow too large")
            rows.select(F.lit(number).alias("silo"), "seq", "record").repartition(1).sortWithinPartitions("seq").select("silo", "record").write.format("silo").mode("append").option("append", "true").save(self.root)
            self._append(P.reindex(self.records(silos=[number]).where(F.col("offset") >= before[0][1])).drop("matched"))
        finally:
            self._drop()

    def housekeeping(self) -> None:
        """Merge the appendix into the sorted index.

        The merged table is written beside the old one, which moves out of the way
        and goes last, after the batches that were merged; meeting one of those
        twice adds nothing.  A run that was broken off is put right by the next."""
        system, root = files.split(f"{self.root}/index")
        there = lambda name: files.exists(f"{self.root}/index/{name}")
        if there("previous"):  # broken off between the moves, or before the end
            system.delete_dir(f"{root}/previous") if there("sorted") else system.move(f"{root}/previous", f"{root}/sorted")
        if there("merged"):
            system.delete_dir(f"{root}/merged")
        batches = sorted({p.rsplit("/", 1)[0] for p, *_ in files.listed(f"{self.root}/index/appendix", ".parquet")})
        empty = self.spark.createDataFrame([], KEY)
        base = self.spark.read.schema(KEY).parquet(f"{self.root}/index/sorted") if self._some(f"{self.root}/index/sorted") else empty
        delta = self.spark.read.schema(KEY).parquet(*batches) if batches else empty
        A.housekeep(base, delta).write.parquet(f"{self.root}/index/merged")
        if there("sorted"):
            system.move(f"{root}/sorted", f"{root}/previous")
        system.move(f"{root}/merged", f"{root}/sorted")
        for batch in batches:
            system.delete_dir(batch)
        if there("previous"):
            system.delete_dir(f"{root}/previous")

    def snapshot(self, target: str, contents: DataFrame, time: int) -> DataFrame:
        """Store what is missing of a folder's files (dirname, filename, content),
        then its manifest, then a report that refers to the manifest; one row
        (manifest, report).  Empty files are left out."""
        rows = contents.where("octet_length(content) > 0").select("dirname", "filename", F.sha2("content", 256).alias("digest"), "content")
        manifest = self._table(rows.select("dirname", "filename", "digest").withColumn("pos", F.monotonically_increasing_id()), "manifest")
        missing = self._table(A.snapshot_missing(manifest, self.index()).select("digest"), "missing")
        wanted = rows.join(missing, "digest", "left_semi").dropDuplicates(["digest"])
        self._keep(lambda: self.store(wanted.select(F.xxhash64("digest").alias("seq"), F.col("content").alias("payload"))))
        entries = manifest.select(F.format_string("%s/%s sha256digest=%s", "dirname", "filename", "digest").alias("line"))
        listing = entries.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary").alias("payload"))  # the manifest is one object
        key = self._keep(lambda: self.store(listing.where("length(payload) > 0").withColumn("seq", F.lit(0).cast("long")))).first()
        if key is None:
            return self.spark.createDataFrame([], "manifest string, report string")
        nothing = manifest.limit(0).select("digest", F.lit("").alias("id"), F.lit("").alias("error"))
        report = A.snapshot_report(target, key["id"], nothing, nothing, time)
        body = report.select(F.lit(0).cast("long").alias("seq"), F.col("report").cast("binary").alias("payload"), F.lit(key["id"]).alias("refers_to"), F.lit("application/json").alias("content_type"))
        self._keep(lambda: self.store(body, "metadata"))
        self._drop()
        return report.select(F.lit(key["id"]).alias("manifest"), "report")

    def _keep(self, work):
        """Run a command without losing this one's intermediates."""
        drop, self._drop = self._drop, lambda: None
        try:
            return work()
        finally:
            self._drop = drop

    # --- commands that only read

    def info(self, as_json: bool = False) -> str:
        size = self.config.id_size
        return json.dumps(["stratavault", "info", "1", {"id_size": size}]) if as_json else f"id_size: {size}"

    def dump_index(self, parts: list[str] | None = None, flags: int | None = None) -> DataFrame:
        return A.dump_index(self.index(), parts, flags).select(A.dump_line().alias("line"))

    def visit(self, part: str, function) -> int:
        """Call ``function(key, flags, silo, offset, cont)`` for the rows of an id
        part until it returns something but 0, which is returned."""
        for r in A.dump_index(self.index(), [part]).toLocalIterator():
            if code := function(r["key"], r["flags"], r["silo"], r["offset"], r["cont"]):
                return code
        return 0

    def by_id(self, fragments: DataFrame) -> DataFrame:
        """(fragment) to (fragment, line): id and type of each record that matches."""
        return A.by_id_lines(A.by_id(self.index(), fragments), self.records())

    def filter(self, candidates: DataFrame, mode: str = "missing", verify: bool = False, out: str | None = None) -> DataFrame:
        """Lines of (pos, line, id) that the index lacks or has, or all with 0/1."""
        found = A.filter_ids(candidates, self.index(), mode, self.records().select(F.col("record_id").alias("id")) if verify else None).orderBy("pos")
        if out is not None:
            found.select("line").write.text(out)
        return found

    def get(self, ids: DataFrame) -> DataFrame:
        """(pos, id) to what is found and whether it is intact."""
        return P.get_objects(ids, self.index(), self.records(), self.records(body=True))

    def bodies(self, ids: DataFrame, gzip: bool = False) -> DataFrame:
        """(pos, id) to (pos, id, number, body): the segments of each object in
        order, as they are or as gzip members."""
        column = "body_gz" if gzip else "body"
        found = P.locate(ids, self.index(), self.records().select("silo", "offset", "record_id")).where("problem is null")
        found = found.select("pos", "id", F.col("silo").alias("at_silo"), F.col("offset").alias("at"))
        number = F.col("segment_number").try_cast("int")
        parts = self.records(body=not gzip, raw=gzip).select(
            P.origin_of(F.col("record_id"), F.col("segment_number"), F.col("segment_origin_id")).alias("origin"), F.when(number > 1, number).otherwise(1).alias("number"), "silo", "offset", F.col(column).alias("body")
        )
        parts = found.join(parts, F.lower("id") == F.col("origin")).where("number > 1 or silo = at_silo and offset = at")
        return parts.select("pos", "id", "number", "body")

    def save(self, ids: DataFrame, out: str, gzip: bool = False) -> None:
        """Write each object to a file of its id below ``out``."""
        files.make_parent(f"{out.rstrip('/')}/x")

        def write(batches):
            file, now = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    id_, body = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                    if id_ != now:
                        if file is not None:
                            file.close()
                        system, path = files.split(f"{out.rstrip('/')}/{id_}" + (".gz" if gzip else ""))
                        file, now = system.open_output_stream(path, compression=None), id_
                    file.write(body or b"")
                yield batch.slice(0, 0)
            if file is not None:
                file.close()

        rows = self.bodies(ids.dropDuplicates(["id"]), gzip).select("id", "number", "body")
        rows = P.clustered(rows, "id", "number")
        rows.mapInArrow(write, rows.schema).count()

    def serve(self, requests: DataFrame) -> DataFrame:
        """Response heads of (pos, path_info, accept_encoding)."""
        return P.respond(requests, self.get(requests.select("pos", X.request_id(F.col("path_info")).alias("id"))))

    def audit(self, ignore_metadata_id: bool = False) -> DataFrame:
        return P.audit_silos(self.records(body=True), ignore_metadata_id)

    def reindex(self) -> DataFrame:
        """Index rows of all silos; segments that stay alone are matched with the index."""
        return P.rematch(P.reindex(self.records()), self.index())

    def rebuild(self, out: str) -> None:
        """Write all silos anew below ``out``: obsolete header fields go, legacy
        records get the digest of their body as block digest and id."""
        rows = self.records(body=True, lenient=True)
        rows = rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(F.lit(True)))
        new = A.rebuild_headers(rows.withColumn("headers", A.proper_names(F.col("headers"))))
        header = X.serialize_header(F.col("new_id"), F.col("new_headers"))
        encoded = P.encode_records(new.select(F.col("silo").alias("seq"), F.col("offset").alias("number"), header.alias("header"), "body"))
        P.clustered(encoded, "seq", "number").select(F.col("seq").cast("int").alias("silo"), "record").write.format("silo").mode("append").save(out)
