"""Continuous intake: a stream of file rows, each micro-batch run through the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.incremental import Ledger


def follow(spark: SparkSession, folder: str, schema: str, root: str, job: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True, version: str | None = None):
    """Starts a query over parquet files that arrive in ``folder`` (project, relative_path, size, checksum and others).

    A micro-batch is a ledger batch named by its number, so one that is retried
    replaces its own output and none is counted twice.  Of several rows of a file
    in a micro-batch the newest counts: that with the largest ``version`` (a
    column; nulls first), then that of the parquet file written last, of equal
    times of the larger name, and in it the last row, so a retry takes the same.
    """
    ledger = Ledger(spark, root)

    def batch(df: DataFrame, number: int) -> None:
        order = [F.col(version)] if version else []
        order += [F.col(f"__arrived.{c}") for c in ("file_modification_time", "file_path", "row_index")]
        columns = [c for c in df.columns if c != "__arrived"]
        newest = df.groupBy("project", "relative_path").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__row"))
        ledger.run(f"stream-{number:012d}", newest.select("__row.*"), job)

    rows = spark.readStream.schema(schema).parquet(folder)
    writer = rows.select("*", F.col("_metadata").alias("__arrived")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
