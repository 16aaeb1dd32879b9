"""Shared plumbing: table access, intermediate tables and bucket counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is
    unset, a temporary folder will do on one machine; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: there is no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratavault-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/stratavault/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            _written.pop(path, None)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and keeps later
    reads columnar."""
    spark = df.sparkSession
    path = new_path(spark, label)
    # shuffle files of a finished write are of no further use
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file sizes for a scan); where it
    knows nothing (petabytes and more), the texts are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 52:
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
        size = int(df.agg(F.sum(sum(texts, F.lit(0)).cast("decimal(38,0)"))).first()[0] or 0)
    return size


def bucket_count(df: DataFrame, bytes_each: int) -> int:
    """How many hash buckets keep one bucket of data derived from ``df`` near
    ``bytes_each`` bytes: grows with the input, at least four a shuffle
    partition so that tasks stay even."""
    spark = df.sparkSession
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(1 << 24, max(least, -(-input_bytes(df) // bytes_each)))


def word_count(text: F.Column) -> F.Column:
    """Number of words in a text (null: 0), evaluated in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
