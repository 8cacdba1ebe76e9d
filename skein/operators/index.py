"""Building and changing a stored index of units: parquet by project, versions named by manifests."""

from __future__ import annotations

import json
import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from skein import schema as S
from skein.functions import text as T
from skein.functions.rows import ship
from skein.functions.state import read_text, write_text
from skein.models import Embedder

#: Texts given to the model at once.
BATCH = 64


def embed(units: DataFrame, model: Embedder, context: int = 4096) -> DataFrame:
    """Units other than files with their vector, or with ``error`` where the model failed; one failure does not stop the rest.

    Texts go to the model in batches of ``BATCH``; those of a batch that fails
    are tried one by one.  ``attempts`` and ``ms`` tell what a unit took.
    """
    ship(units.sparkSession)
    columns = [f for f in S.UNITS.fields if f.name not in ("vector",)]
    rows = units.where("type <> 'file'").select(*[f.name for f in columns], T.embed_text("content", context).alias("__text"))

    def ask(texts: list[str]) -> tuple[list, list[int], float]:
        began = time.perf_counter()
        vectors = model.embed(texts)
        if len(vectors) != len(texts):
            raise ValueError("the model gave another number of vectors")
        return vectors, list(getattr(model, "attempts", None) or [1] * len(texts)), 1000 * (time.perf_counter() - began) / len(texts)

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                pdf = whole.iloc[at : at + BATCH]
                texts = list(pdf["__text"])
                try:
                    vectors, attempts, each = ask(texts)
                    errors, ms = [None] * len(texts), [each] * len(texts)
                except Exception:
                    vectors, errors, attempts, ms = [], [], [], []
                    for text in texts:
                        began = time.perf_counter()
                        try:
                            v, n, _ = ask([text])
                            vectors.append(v[0])
                            errors.append(None)
                            attempts.append(n[0] + 1)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(str(e)[:500])
                            attempts.append(max(list(getattr(model, "attempts", None) or [1])) + 1)
                        ms.append(1000 * (time.perf_counter() - began))
                yield pdf.drop(columns="__text").assign(vector=pd.Series(vectors, dtype=object, index=pdf.index), error=pd.Series(errors, dtype=object, index=pdf.index), attempts=attempts, ms=ms)

    schema = T_.StructType([*columns, S.UNITS["vector"]]).add("error", "string").add("attempts", "integer").add("ms", "double")
    return rows.mapInPandas(run, schema)


def embedding_stats(done: DataFrame) -> DataFrame:
    """(calls, failed, average_attempts, first_try_percent, average_ms) of rows with ``error``, ``attempts`` and ``ms``; averages are of calls that did not fail, 0 where there is none."""
    good = F.col("error").isNull()

    def average(x):
        return F.coalesce(F.avg(F.when(good, x)), F.lit(0.0))

    return done.agg(F.count(F.lit(1)).alias("calls"), F.count_if(~good).alias("failed"), F.round(average(F.col("attempts")), 2).alias("average_attempts"), F.round(100 * average((F.col("attempts") == 1).cast("int")), 1).alias("first_try_percent"), F.round(average(F.col("ms")), 1).alias("average_ms"))


class Index:
    """Rows of one schema with a ``project``, under ``root/data/v=V/project=P``.

    ``root/manifests/N.json`` is the N-th version: for each project's folder the
    versions of the data that make it up.  A change writes only the projects it
    touches and then its manifest, under a name that can be taken once; readers
    see the last manifest, whole.  ``vacuum`` removes what no kept version names.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T_.StructType = S.UNITS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _manifest(self, version: int | None = None) -> dict[str, list[str]]:
        n = version or self.version()
        return json.loads(read_text(*self._fs(f"manifests/{n}.json"))) if n else {}

    def _folder(self, project: str | None) -> str:
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return utils.getPartitionPathString("project", project)

    def _rows(self, manifest: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.root}/data/v={v}/{name}" for name, vs in manifest.items() for v in vs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        schema = T_.StructType([*[f for f in self.schema.fields if f.name != "project"], T_.StructField("v", T_.StringType()), T_.StructField("project", T_.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths).select(*self.schema.fieldNames())

    def read(self, projects: list[str] | None = None) -> DataFrame | None:
        """The rows of the last version, of some projects or of all; None if there is no version."""
        if not self.version():
            return None
        manifest = self._manifest()
        wanted = None if projects is None else {self._folder(p) for p in projects}
        return self._rows({n: vs for n, vs in manifest.items() if wanted is None or n in wanted})

    def _write(self, rows: DataFrame, base: int, keep: dict[str, list[str]], add: bool) -> int:
        n = base + 1
        part = f"{n}_{uuid.uuid4().hex[:12]}"
        rows.select(*self.schema.fieldNames()).write.partitionBy("project").parquet(f"{self.root}/data/v={part}")
        written = [x for x in self._names(f"data/v={part}") if x.startswith("project=")]
        manifest = keep | {x: [*(keep.get(x, []) if add else []), part] for x in written}
        fs, folder = self._fs("manifests")
        fs.mkdirs(folder)
        _, temporary = self._fs(f"manifests/.{uuid.uuid4().hex}")
        write_text(fs, temporary, json.dumps(manifest))
        if not fs.rename(temporary, self._fs(f"manifests/{n}.json")[1]):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {n} was written by another run")
        return n

    def append(self, rows: DataFrame) -> int:
        """A version with the rows added, as they are; the first one if there is none."""
        base = self.version()
        return self._write(rows, base, self._manifest(base), True)

    def replace(self, rows: DataFrame, touched: DataFrame) -> int:
        """A version in which the rows of the touched files (project, relative_path) are the given ones; the rest stays.

        Only projects with touched files are read and written.  Running it again
        with the same rows changes nothing.  Rows of files that are not among the
        touched are added.
        """
        base = self.version()
        manifest = self._manifest(base)
        keys = touched.select("project", "relative_path").distinct()
        projects = [r[0] for r in keys.select("project").union(rows.select("project")).distinct().collect()]  # as many as there are projects
        names = {self._folder(p) for p in projects}
        old = self._rows({n: vs for n, vs in manifest.items() if n in names})
        same = F.col("o.project").eqNullSafe(F.col("k.project")) & F.col("o.relative_path").eqNullSafe(F.col("k.relative_path"))
        kept = old.alias("o").join(keys.alias("k"), same, "left_anti")
        return self._write(kept.unionByName(rows.select(*self.schema.fieldNames())), base, {n: vs for n, vs in manifest.items() if n not in names}, False)

    def replace_project(self, project: str, rows: DataFrame) -> int:
        """A version in which the project consists of the given rows alone."""
        base = self.version()
        manifest = self._manifest(base)
        return self._write(rows.where(F.col("project") == project), base, {n: vs for n, vs in manifest.items() if n != self._folder(project)}, False)

    def delete(self, touched: DataFrame) -> int:
        return self.replace(self.spark.createDataFrame([], self.schema), touched)

    def clear(self) -> None:
        """Removes all versions."""
        for folder in ("manifests", "data"):
            fs, path = self._fs(folder)
            fs.delete(path, True)

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions, and data that none of them names."""
        kept = self.versions()[-max(1, keep) :]
        live = {v for n in kept for vs in self._manifest(n).values() for v in vs}
        for n in self.versions():
            if n not in kept:
                fs, path = self._fs(f"manifests/{n}.json")
                fs.delete(path, False)
        for name in self._names("data"):
            if name.startswith("v=") and name[2:] not in live and int(name[2:].split("_")[0]) <= max(kept, default=0):
                fs, path = self._fs(f"data/{name}")
                fs.delete(path, True)


def without_paths(units: DataFrame, paths: DataFrame) -> DataFrame:
    """Units whose (project, file_path) is not among the given; null fields equal nothing, so such units stay."""
    return units.join(paths.select("project", "file_path").distinct(), ["project", "file_path"], "left_anti")
