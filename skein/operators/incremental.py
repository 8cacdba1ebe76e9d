"""Processing only new or changed records.

``pending`` tells which files a run must process; ``Ledger`` runs a job over
what is pending with exactly one effect per record: output is written under the
batch's identifier (a batch that is run again replaces its own output), and only
then does one manifest entry commit the batch.  A failure before the commit
leaves the batch pending; a failure after it leaves nothing to do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.state import read_text, write_text


def slashed(path: Column) -> Column:
    """A path with slashes only, so that both separators compare equal."""
    return F.regexp_replace(path, r"\\", "/")


def present(files: DataFrame) -> DataFrame:
    """The present row of each file: that with the latest scanned_at (nulls first; of equal times the largest mtime and size).

    Rows without project or relative_path name no file and are left out.
    """
    named = files.where("project is not null and relative_path is not null").select("project", slashed(F.col("relative_path")).alias("relative_path"), F.struct("scanned_at", "mtime_ms", "size").alias("now"))
    return named.groupBy("project", "relative_path").agg(F.max("now").alias("now"))


def recorded(state: DataFrame, runs: DataFrame) -> DataFrame:
    """What the last successful run that lists a file recorded about it.

    Last is the latest finished_at (nulls first; of equal times the largest
    run_id, then the largest mtime and size), whatever other runs listed.
    """
    good = runs.where("status = 'success'").groupBy("run_id", "project_id").agg(F.max("finished_at").alias("finished_at"))
    rows = state.where("project_id is not null and relative_path is not null").select(F.col("project_id"), slashed(F.col("relative_path")).alias("relative_path"), "run_id", "mtime_ms", "size")
    joined = rows.join(good, ["run_id", "project_id"])
    last = F.struct("finished_at", "run_id", "mtime_ms", "size")
    return joined.groupBy(F.col("project_id").alias("project"), "relative_path").agg(F.max(last).alias("last"))


def changes(files: DataFrame, state: DataFrame, runs: DataFrame) -> DataFrame:
    """(project, relative_path, status) of every file known to either side: added, modified, deleted or unchanged.

    Null differs from a number and equals null.  The aggregates and the join use
    the same keys, so each side is shuffled once.
    """
    now, then = present(files), recorded(state, runs)
    same = F.col("now.mtime_ms").eqNullSafe(F.col("last.mtime_ms")) & F.col("now.size").eqNullSafe(F.col("last.size"))
    status = F.when(F.col("last").isNull(), "added").when(F.col("now").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return now.join(then, ["project", "relative_path"], "full_outer").select("project", "relative_path", status.alias("status"))


KEYS = ("project", "relative_path")
#: What tells a processed record from a changed one.
MARKS = ("size", "checksum")


def unprocessed(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the listing (keys, size, checksum and any others) without an equal entry in the manifest; null equals null.

    One anti-join on keys and marks: a record that is new and one that has
    changed both lack their entry.
    """
    done = manifest.select(*[F.col(c).alias(f"__{c}") for c in (*KEYS, *MARKS)])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*KEYS, *MARKS)]
    return listing.join(done, reduce(and_, same), "left_anti")


def pending(files: DataFrame, state: DataFrame, runs: DataFrame) -> DataFrame:
    """(project, relative_path) of each file that a run must process.

    The present rows are the listing, and what the last successful runs recorded
    is the manifest; the recorded mtime stands for the checksum, which these tables lack.
    """
    listing = present(files).select(*KEYS, F.col("now.size").alias("size"), F.col("now.mtime_ms").alias("checksum"))
    manifest = recorded(state, runs).select(*KEYS, F.col("last.size").alias("size"), F.col("last.mtime_ms").alias("checksum"))
    return unprocessed(listing, manifest).select(*KEYS)


class Ledger:
    """A manifest of processed input with size and checksum, kept beside the output in ``root``.

    ``root/output/batch=ID`` holds results, ``root/manifest/batch=ID`` what the
    batch processed, ``root/commits/N.json`` the N-th commit.  Rows without a
    commit do not count.  Of several commits that name a record the last one
    counts, in the manifest and in the output; a batch that two runs commit at
    once is numbered apart, since a commit's name can be taken only once.
    """

    KEYS = KEYS

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _commits(self) -> dict[int, dict]:
        """Commits by number, from the last one that stands for all before it."""
        fs, path = self._fs()
        folder = path(f"{self.root}/commits")
        if not fs.exists(folder):
            return {}
        numbers = sorted((int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName()[:-5].isdigit()), reverse=True)
        found: dict[int, dict] = {}
        for n in numbers:
            found[n] = json.loads(read_text(fs, path(f"{self.root}/commits/{n:012d}.json")))
            if found[n].get("snapshot"):
                break
        return dict(sorted(found.items()))

    def commits(self) -> list[str]:
        """Names of committed batches, those that a snapshot stands for included."""
        found = self._commits()
        return sorted({b for c in found.values() for b in (c.get("batches") or [c["batch"]])})

    def _commit(self, entry: dict) -> int:
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/commits"))
        temporary = path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        write_text(fs, temporary, json.dumps(entry))
        number = max(self._commits(), default=-1) + 1
        while not fs.rename(temporary, path(f"{self.root}/commits/{number:012d}.json")):
            number += 1  # taken by another run meanwhile
        return number

    def _winners(self) -> DataFrame | None:
        """(keys, marks, deleted, batch) of the last commit of each record."""
        done = self._commits()
        if not done:
            return None
        order = F.create_map(*[F.lit(x) for n, c in done.items() for x in (c["batch"], n)])
        schema = "project string, relative_path string, size long, checksum string, deleted boolean, batch string"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/manifest").parquet(*[f"{self.root}/manifest/batch={c['batch']}" for c in done.values()])
        last = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*MARKS, "deleted", "batch"), F.element_at(order, F.col("batch"))).alias("entry"))
        return last.select(*KEYS, "entry.*")

    def processed(self) -> DataFrame | None:
        """Manifest: the latest committed entry of each record that is not gone."""
        last = self._winners()
        return None if last is None else last.where("not deleted").select(*KEYS, *MARKS)

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of the listing (keys, size, checksum and any others) that no committed batch processed as they are now."""
        done = self.processed()
        return listing if done is None else unprocessed(listing, done)

    def run(self, batch: str, listing: DataFrame, job: Callable[[DataFrame], DataFrame], complete: bool = False) -> int:
        """Processes what is pending as batch ``batch``; gives the number of records, 0 if the batch is committed already.

        The result of ``job`` keeps the keys, by which the output of older
        versions is left out later.  ``complete``: the listing names every
        record, so processed ones that it lacks are recorded as gone.
        """
        if batch in self.commits():
            return 0
        todo = self.pending(listing).select(*KEYS, *MARKS, F.lit(False).alias("deleted"))
        done = self.processed()
        if complete and done is not None:
            same = [F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}")) for k in KEYS]
            gone = done.alias("d").join(listing.select(*KEYS).alias("l"), reduce(and_, same), "left_anti")
            todo = todo.unionByName(gone.withColumn("deleted", F.lit(True)))
        manifest = f"{self.root}/manifest/batch={batch}"
        kinds = dict(listing.dtypes)
        todo.withColumn("size", F.col("size").cast("long")).withColumn("checksum", F.col("checksum").cast("string")).write.mode("overwrite").parquet(manifest)
        # the manifest, not the listing that may change meanwhile, fixes what belongs to the batch
        fixed = self.spark.read.parquet(manifest).where("not deleted").select(*KEYS, *[F.col(c).cast(kinds[c]).alias(c) for c in MARKS])
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in (*KEYS, *MARKS)]
        out = job(listing.alias("l").join(fixed.alias("m"), reduce(and_, same), "left_semi"))
        if not set(KEYS) <= set(out.columns):
            raise ValueError("the result must keep " + " and ".join(KEYS))
        out.write.mode("overwrite").parquet(f"{self.root}/output/batch={batch}")
        n = fixed.count()
        self._commit({"batch": batch, "records": n})
        return n

    def output(self) -> DataFrame | None:
        """Results of committed batches: of each record those of its last version only, of records that are gone none."""
        last = self._winners()
        if last is None:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/output").option("mergeSchema", "true").parquet(*[f"{self.root}/output/batch={c['batch']}" for c in self._commits().values()])
        rows = rows.withColumn("batch", F.col("batch").cast("string"))
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"w.{k}")) for k in (*KEYS, "batch")]
        return rows.alias("o").join(last.where("not deleted").alias("w"), reduce(and_, same), "left_semi")

    def compact(self, batch: str) -> None:
        """One batch in the place of all committed so far, so that later runs read one manifest; the old folders stay for readers until ``vacuum``."""
        done = self._commits()
        last = self._winners()
        if last is None or batch in self.commits():
            return
        last.where("not deleted").drop("batch").write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
        self.output().drop("batch").write.mode("overwrite").parquet(f"{self.root}/output/batch={batch}")
        if self._commits().keys() != done.keys():
            raise RuntimeError("another run committed during the compaction; call it again")
        self._commit({"batch": batch, "batches": sorted({*self.commits(), batch}), "snapshot": True})

    def vacuum(self) -> None:
        """Removes the folders of batches that a snapshot stands for."""
        fs, path = self._fs()
        live = {f"batch={c['batch']}" for c in self._commits().values()}
        snapshot = next((c for c in self._commits().values() if c.get("snapshot")), None)
        for b in snapshot["batches"] if snapshot else []:
            for kind in ("manifest", "output"):
                if f"batch={b}" not in live:
                    fs.delete(path(f"{self.root}/{kind}/batch={b}"), True)
