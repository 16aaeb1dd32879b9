"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from . import files

_made: list[str] = []


@atexit.register
def _remove_all() -> None:
    for path in _made:
        try:
            system, inner = files.split(path)
            if files.exists(path):
                system.delete_dir(inner)
        except Exception:  # the folder's owner cleans up
            continue


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path, removed when the driver ends, below ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder will do on one machine; on a cluster it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: there is no folder that all executors share")
        shared = "file://" + tempfile.mkdtemp()
    path = f"{shared.rstrip('/')}/stratavault-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path
