"""Streaming ingest: micro-batches of payloads against what is stored already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import files
from ..sources.shared import new_folder

KIND = "id string, seq long"


def stored_ids(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """What is stored below ``folder``, or was before a batch: the batches are
    read by number, so a batch that runs again doesn't meet its own rows."""
    found = {p.rsplit("/", 2)[1] for p, *_ in files.listed(f"{folder}/stored", ".parquet")}
    batches = [f"{folder}/stored/{x}" for x in sorted(found) if before is None or int(x.split("=")[1]) < before]
    return spark.read.schema(KIND).parquet(*batches) if batches else spark.createDataFrame([], KIND)


def compact(spark: SparkSession, folder: str) -> None:
    """Merge all batches so far into the last of them."""
    found = sorted({p.rsplit("/", 2)[1] for p, *_ in files.listed(f"{folder}/stored", ".parquet")}, key=lambda x: int(x.split("=")[1]))
    if len(found) < 2:
        return
    merged = f"{folder}/merged"
    stored_ids(spark, folder).repartitionByRange("id").write.mode("overwrite").parquet(merged)
    system, path = files.split(merged)
    for name in found:
        system.delete_dir(files.split(f"{folder}/stored/{name}")[1])
    system.move(path, files.split(f"{folder}/stored/{found[-1]}")[1])


def stream_dedup(spark: SparkSession, path: str, files_each: int = 4, folder: str | None = None) -> DataFrame:
    """Ingest ``path`` as a stream; the stored ids with their first row.

    Each micro-batch is anti-joined with the stored table and appended to it, so
    no state store grows without bound.  With the same ``folder`` a later call
    goes on where an earlier one ended."""
    folder = folder or new_folder(spark, "stream")
    schema = spark.read.parquet(path).schema

    def add(batch: DataFrame, number: int) -> None:
        new = batch.where("text is not null and text <> ''").groupBy(X.ident(F.col("text")).alias("id")).agg(F.min("doc_id").alias("seq"))
        new = new.join(stored_ids(batch.sparkSession, folder, number), "id", "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/stored/batch={number}")  # a repeated batch replaces itself

    source = f"{path[:-1]}[{path[-1]}]"  # a pattern takes a single file as well as a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stored_ids(spark, folder)


def stream_store(archive, path: str, folder: str | None = None, files_each: int = 4) -> None:
    """Store (seq, payload) files of ``path`` as they come.  A batch that runs
    again adds nothing, as its payloads are there."""
    spark = archive.spark
    folder = folder or new_folder(spark, "stream")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_each).parquet(path)
    query = stream.writeStream.foreachBatch(lambda batch, _: archive.store(batch)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def spread(payloads: DataFrame, path: str, size: int = 1 << 26, least: int = 3) -> int:
    """Write (seq, payload) as files in order of ``seq``, each of about ``size``
    bytes of payload, ``least`` files at least; how many."""
    total = payloads.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0
    files_ = max(least, -(-total // size))
    payloads.repartitionByRange(files_, "seq").write.parquet(path)
    return files_
