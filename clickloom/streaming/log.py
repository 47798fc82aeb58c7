"""A log of micro-batches that readers always see whole.

Data goes to a folder of its own for each attempt at writing it; what counts is the manifest. A
commit is one manifest file of a few rows, put in place by one rename, and a batch that has one is
not written again. Readers take the folders that the manifest names and nothing else, so they see
neither a half-written batch nor a gap while one is run again. Compaction replaces many batches by
one commit; the folders it replaces stay until :meth:`VersionedLog.vacuum`, for readers under way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "kind string, run long, first long, last long, part string, folder string"
BATCH, MERGED, RUN = "batch", "merged", "run"


class VersionedLog:
    """Commits of a job to ``path``. A run is one checkpoint's sequence of batches."""

    def __init__(self, spark: SparkSession, path: str, files: int = 4):
        self.spark, self.path, self.files = spark, path, files

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entry(self, run: int, name: str) -> str:
        return f"{self.path}/manifest/run-{run:06d}-{name}"

    def committed(self, batch_id: int, run: int = 0) -> bool:
        """Whether a batch is in the log, by itself or merged with others."""
        where, files = self._hadoop(f"{self._entry(run, f'batch-{batch_id:012d}')}/_SUCCESS")
        if files.exists(where):
            return True
        return any(
            row.run == run and batch_id <= row.last for row in self.manifest() if row.kind == MERGED
        )

    def _put(self, entry: str, rows: list[tuple]) -> None:
        # One file: its rename into place is the commit.
        frame = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(entry)

    def commit(self, batch_id: int, parts: dict[str, DataFrame], run: int = 0) -> bool:
        """Write the parts of a batch and make them visible together; False if it was there."""
        if self.committed(batch_id, run):
            return False
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        for name, frame in parts.items():
            frame.repartition(self.files).write.parquet(f"{folder}/{name}")
        rows = [(BATCH, run, batch_id, batch_id, name, f"{folder}/{name}") for name in parts]
        self._put(self._entry(run, f"batch-{batch_id:012d}"), rows)
        return True

    def pass_over(self, batch: DataFrame) -> None:
        """Run a batch that is in the log already, so that its state is written all the same."""
        batch.write.format("noop").mode("overwrite").save()

    def manifest(self) -> list[Row]:
        """All commits: a few rows for each batch since the last compaction."""
        where, files = self._hadoop(f"{self.path}/manifest")
        if not files.exists(where):
            return []
        read = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True)
        return read.parquet(f"{self.path}/manifest").collect()

    def _current(self) -> list[Row]:
        """The commits that hold: the newest merge, and the batches it does not cover."""
        rows = self.manifest()
        newest = max((row.first for row in rows if row.kind == MERGED), default=-1)
        merged = [row for row in rows if row.kind == MERGED and row.first == newest]
        covered = {row.run: row.last for row in merged}
        batches = [r for r in rows if r.kind == BATCH and r.last > covered.get(r.run, -1)]
        return merged + batches

    def last_batches(self) -> dict[int, int]:
        """The newest batch of every run."""
        found: dict[int, int] = {}
        for row in self.manifest():
            if row.kind in (BATCH, MERGED):
                found[row.run] = max(found.get(row.run, -1), row.last)
        return found

    def run_of(self, checkpoint: str) -> int:
        """The number of the run that a checkpoint belongs to, a new one for a new checkpoint. One
        that is not the newest is refused: its state lacks what later runs have counted."""
        runs = {row.folder: row.run for row in self.manifest() if row.kind == RUN}
        newest = max(runs.values(), default=-1)
        where, files = self._hadoop(f"{checkpoint}/metadata")
        if checkpoint in runs and files.exists(where):
            if runs[checkpoint] < newest:
                raise ValueError(f"run {newest} has gone on from what {checkpoint} holds")
            return runs[checkpoint]
        self._put(self._entry(newest + 1, "start"), [(RUN, newest + 1, -1, -1, "", checkpoint)])
        return newest + 1

    def folders(self, part: str) -> list[str]:
        return sorted({row.folder for row in self._current() if row.part == part})

    def read(self, part: str, schema: str | StructType) -> DataFrame:
        """One part of all batches that are committed now."""
        folders = self.folders(part)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def merge(self, covered: dict[int, int], parts: dict[str, Iterable[str]]) -> None:
        """Let these folders stand for all batches up to the last one given for each run, and for
        every merge before, in one commit."""
        rows = self.manifest()
        number = max((row.first for row in rows if row.kind == MERGED), default=-1) + 1
        told = [(MERGED, run, number, last, "", "") for run, last in covered.items()]
        run, last = max(covered.items())
        told += [(MERGED, run, number, last, name, place) for name, all_ in parts.items() for place in all_]
        self._put(f"{self.path}/manifest/merged-{number:012d}", told)

    def vacuum(self) -> int:
        """Delete folders and manifest files that no commit in force names. Only for a time when
        no reader older than the last merge is at work; returns the number of folders deleted."""
        current = self._current()
        held = {row.folder for row in current}
        numbers = {row.first for row in current if row.kind == MERGED}
        gone = 0
        for row in self.manifest():
            if row.folder and row.folder not in held:
                where, files = self._hadoop(row.folder)
                gone += bool(files.delete(where, True))
            if row.kind == BATCH and row not in current:
                entry, files = self._hadoop(self._entry(row.run, f"batch-{row.last:012d}"))
                files.delete(entry, True)
            elif row.kind == MERGED and row.first not in numbers:
                entry, files = self._hadoop(f"{self.path}/manifest/merged-{row.first:012d}")
                files.delete(entry, True)
        return gone
