"""Published versions of tables: immutable folders and one manifest a generation.

A run writes each of its stages once, below a folder of its own; a stage whose
write has ended is read again rather than made again, so a run that was killed
goes on where it stopped.  Publishing is the creation of one small file, the
manifest of the next generation, that names the folders of its tables: readers
see the old version or the new one and nothing between.  The file is put in
place by a rename that never replaces one, so of two runs that publish at once
one wins and the other starts from what it finds.  A run publishes once: its
name is in its manifest, and a rerun finds it there.

The folder must be shared by driver and executors.  Generations only rise.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has published since this one began."""


@dataclass(frozen=True)
class Version:
    generation: int
    run: str
    tables: dict[str, str]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a local one for a local master (tests)."""
    key = "spark.checkpoint.dir"
    path = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} names no folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="trailmill-")
        spark.conf.set(key, path)
    return path.rstrip("/")


class Versions:
    """Versions of some tables below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _read(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifests(self) -> list[tuple[int, object]]:
        folder = self._of(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder)]
        return sorted((int(p.getName().split(".")[0]), p) for p in found if p.getName().endswith(".json") and not p.getName().startswith((".", "_")))

    def versions(self) -> list[Version]:
        return [Version(n, **self._read(p)) for n, p in self._manifests()]

    def current(self) -> Version | None:
        found = self._manifests()
        return Version(found[-1][0], **self._read(found[-1][1])) if found else None

    def of_run(self, run: str) -> Version | None:
        return next((v for v in reversed(self.versions()) if v.run == run), None)

    def table(self, name: str, version: Version | None = None) -> DataFrame | None:
        """A table of a version, the current one by default; None where nothing was published."""
        version = version or self.current()
        return self.spark.read.parquet(version.tables[name]) if version and name in version.tables else None

    def stage(self, run: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written once for this run; a write that did not end is begun anew."""
        path = f"{self.path}/runs/{run}/{name}"
        if not self._fs.exists(self._of(f"{path}/_SUCCESS")):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def stage_path(self, run: str, name: str) -> str:
        return f"{self.path}/runs/{run}/{name}"

    def publish(self, run: str, names: list[str], base: int) -> Version:
        """Makes the run's stages the next version after ``base`` (0: none), all at once; a run that did so before keeps its version."""
        done = self.of_run(run)
        if done:
            return done
        tables = {n: self.stage_path(run, n) for n in names}
        kept = self.current()
        merged = {**(kept.tables if kept else {}), **tables}
        if (kept.generation if kept else 0) != base:
            raise Conflict(f"{run} began at generation {base}, but {kept.generation if kept else 0} is published")
        self._fs.mkdirs(self._of(f"{self.path}/manifests"))
        temporary, final = self._of(f"{self.path}/manifests/_{uuid.uuid4().hex}"), self._of(f"{self.path}/manifests/{base + 1:010d}.json")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"run": run, "tables": merged}, sort_keys=True).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temporary, final, options)  # fails where the file is there
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise Conflict(f"{run} lost generation {base + 1} to another run") from e
            raise
        return Version(base + 1, run, merged)
