"""Reliable intermediate results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that later steps neither compute it again nor lose it with an executor.

    The folder is the session's; where it has none and runs in one process (as
    in tests), a temporary one is set, which goes with the process.  Spark
    removes a checkpoint that is no longer referred to if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\[\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="skein-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def write_text(fs, path, text: str) -> None:
    """A small file through the Hadoop file system."""
    stream = fs.create(path, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def read_text(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
