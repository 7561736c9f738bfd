"""A stored table of the newest row per key, kept up by micro-batches.

A batch adds a delta folder.  Now and then base and deltas are folded into a
new base.  A version is named by one empty file, ``commits/<version>-<base>``,
written last, so readers see a whole version or the one before it.  Folders
that the last few versions do not need are removed, so their number is
bounded, and a reader that has found its version can still finish while newer
ones are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Files:
    """The few file operations of a version, by the file system of the path, wherever that is."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root = root.rstrip("/")
        self._fs = self._path(self._root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self._root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def mark(self, name: str) -> None:
        self._fs.create(self._at(name), True).close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class NewestRows:
    """The newest row of each key under ``root``.

    ``order`` names the column whose greatest value is the newest; without it
    a later batch wins.  Rows of one batch must then be unique by key.
    ``every``: deltas until they are folded into a base; ``kept``: versions
    that stay readable.
    """

    root: str
    schema: StructType
    keys: tuple[str, ...]
    order: str | None = None
    every: int = 8
    kept: int = 3

    def versions(self, spark: SparkSession) -> list[tuple[int, int]]:
        """(version, base) of the versions that are whole, oldest first."""
        names = Files(spark, self.root).names("commits")
        return [tuple(int(n) for n in name.split("_")) for name in names]

    def _parts(self, spark: SparkSession, version: int, base: int) -> DataFrame:
        files = Files(spark, self.root)
        folders = [("base", base)] if base >= 0 else []
        folders += [("delta", v) for v in map(int, files.names("delta")) if base < v <= version]
        parts = [
            spark.read.schema(self.schema).parquet(f"{self.root}/{kind}/{v:012d}").withColumn("_version", F.lit(v))
            for kind, v in folders
        ]
        if not parts:
            return spark.createDataFrame([], self.schema).withColumn("_version", F.lit(0))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Greatest order per key, then the rows that have it: both sides spread by (key, order)."""
        order = self.order or "_version"
        newest = rows.groupBy(*self.keys).agg(F.max(order).alias(order))
        same = F.col(f"r.{order}") == F.col(f"n.{order}")
        for key in self.keys:
            same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"n.{key}"))
        found = rows.alias("r").join(newest.alias("n"), same, "left_semi")
        # With an order column a repeated record may be there in two versions.
        return (found.dropDuplicates([*self.keys, order]) if self.order else found).drop("_version")

    def write(self, batch: DataFrame, version: int) -> None:
        """Add the rows of a batch; a batch that is repeated changes nothing."""
        spark = batch.sparkSession
        files = Files(spark, self.root)
        done = self.versions(spark)
        last, base = done[-1] if done else (-1, -1)
        if version <= last:
            return
        rows = self._newest(batch.withColumn("_version", F.lit(version))) if self.order else batch
        rows.write.mode("overwrite").parquet(f"{self.root}/delta/{version:012d}")
        if version - base >= self.every:
            folded = self._newest(self._parts(spark, version, base))
            folded.write.mode("overwrite").parquet(f"{self.root}/base/{version:012d}")
            base = version
        # Versions are not negative in names; a base of -1 is written as none by the sign of its field.
        files.mark(f"commits/{version:012d}_{base:+013d}")
        self._clean(files, [*done, (version, base)][-self.kept :])

    def _clean(self, files: Files, readable: list[tuple[int, int]]) -> None:
        first, bases = readable[0][0], {base for _, base in readable}
        for name in files.names("commits"):
            if int(name.split("_")[0]) < first:
                files.remove(f"commits/{name}")
        for name in files.names("base"):
            if int(name) not in bases and int(name) < readable[-1][0]:
                files.remove(f"base/{name}")
        for name in files.names("delta"):
            if int(name) <= min(bases):
                files.remove(f"delta/{name}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest whole version; it stays readable while `kept` - 1 more are written."""
        done = self.versions(spark)
        version, base = done[-1] if done else (-1, -1)
        return self._newest(self._parts(spark, version, base))
