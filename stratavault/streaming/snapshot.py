"""The server's side of a directory snapshot, on frames as rows.

Frames are (stream, seq, cmd, payload).  Command 0 is a message, 1 a digest to
look up, 2 a file to store, 3 metadata: the first frame of a run is the
referent's id, the following ones its body, an empty one its end.  Everything is
set-based: batches and runs are numbered by windows within a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Ids that are looked up in one go.
BATCH = 40960
MESSAGE, FILTER, SEND, META = 0, 1, 2, 3


def batches(frames: DataFrame, most: int = BATCH) -> DataFrame:
    """Digests to look up, with the batch they are in: a batch ends at an empty
    frame, or when it is full."""
    order = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = frames.where(F.col("cmd") == FILTER).withColumn("barrier", F.coalesce(F.sum(F.when(F.octet_length("payload") == 0, 1).otherwise(0)).over(order), F.lit(0)))
    rows = rows.where(F.octet_length("payload") > 0)
    nth = F.row_number().over(Window.partitionBy("stream", "barrier").orderBy("seq")) - 1
    return rows.select("stream", "seq", "barrier", F.floor(nth / most).cast("int").alias("part"), F.lower(F.hex("payload")).alias("digest"))


def replies(frames: DataFrame, index: DataFrame, most: int = BATCH) -> DataFrame:
    """(stream, barrier, part, seq, cmd, payload): the digests of each batch that
    the index lacks, or, where it has all, one frame with their number."""
    asked = batches(frames, most)
    known = index.select("key").distinct().withColumn("there", F.lit(True))
    seen = asked.join(known, F.substring("digest", 1, 24) == F.col("key"), "left")
    missing = seen.where("there is null").select("stream", "barrier", "part", "seq", F.lit(FILTER).alias("cmd"), F.unhex("digest").alias("payload"))
    groups = seen.groupBy("stream", "barrier", "part").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("known"), F.max("seq").alias("seq"))
    count = F.unhex(F.lpad(F.hex(F.col("n")), 8, "0"))
    whole = groups.where("n = known").select("stream", "barrier", "part", "seq", F.lit(FILTER).alias("cmd"), count.alias("payload"))
    return missing.unionByName(whole)


def files_sent(frames: DataFrame) -> DataFrame:
    """(stream, seq, payload) of the files to store."""
    return frames.where((F.col("cmd") == SEND) & (F.octet_length("payload") > 0)).select("stream", "seq", "payload")


def metadata_sent(frames: DataFrame) -> DataFrame:
    """(stream, run, refers_to, payload): runs of metadata frames put together."""
    order = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = frames.where(F.col("cmd") == META).withColumn("run", F.coalesce(F.sum(F.when(F.octet_length("payload") == 0, 1).otherwise(0)).over(order), F.lit(0)))
    rows = rows.where(F.octet_length("payload") > 0).withColumn("nth", F.row_number().over(Window.partitionBy("stream", "run").orderBy("seq")))
    ref = F.max(F.when(F.col("nth") == 1, F.decode("payload", "UTF-8")))
    body = F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", F.hex("payload").alias("part")))))
    grouped = rows.groupBy("stream", "run").agg(ref.alias("refers_to"), F.unhex(F.array_join(F.transform(body, lambda x: x["part"]), "")).alias("payload"))
    return grouped


def changed(sent: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files that changed while they were sent: (pos, digest) against the id stored."""
    return wanted.join(sent, "pos").where(F.substring("digest", 1, X.ID_SIZE) != F.col("id")).select("pos", "digest", "id")
