"""Where intermediate tables go."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Only a session on one machine that
    names none gets a temporary folder; on a cluster that would lose data, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="missive-store-"))
    return context.getCheckpointDir()


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of names, sizes and times of the files below a path, as Spark's file system lists them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    digest = 0
    while listed.hasNext():  # in any order: hashes add up
        f = listed.next()
        one = hashlib.sha256(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}".encode()).digest()
        digest = (digest + int.from_bytes(one, "big")) % (1 << 256)
    return f"{digest:064x}"
