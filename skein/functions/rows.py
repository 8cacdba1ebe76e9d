"""Python over Arrow batches: rows in, any number of rows out, a bounded slice at a time."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE = 500


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Runs ``fn`` over slices of at most ``SLICE`` rows, given as tuples in column order.

    ``fn`` sees one slice a call and must not keep rows between calls.
    """
    ship(df.sparkSession)
    struct = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(struct)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = list(fn(zip(*(c.to_pylist() for c in part.columns))))
                if not rows:
                    continue
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return df.mapInArrow(run, struct)


_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the Python workers, once an application, unless they find it by themselves.

    They do where PYTHONPATH names its folder, or on one machine in that folder.
    """
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in paths or context.master.startswith("local[") and os.path.realpath(os.getcwd()) == str(root):
        return
    folder = tempfile.mkdtemp()  # of the driver, which serves the archive to the executors
    context.addPyFile(shutil.make_archive(f"{folder}/skein", "zip", root, "skein"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
