"""A history table that micro-batches move from version to version, each exactly once.

Every version is a folder of its own, and a version counts only once its commit
marker stands beside it.  A batch reads the last version before its own number
that is committed, writes its own, and then the marker: a batch that died
halfway writes its version anew, one that died after the marker does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame, DataFrame, int], DataFrame]


class Snapshots:
    """Versions of a table under a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        if keep < 2:
            raise ValueError("the version before the last is what a replayed batch reads")
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _path(self, *parts: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self, number: int) -> str:
        return f"{self.root}/versions/{number}"

    def committed(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        path, files = self._path("commits")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path)) if files.exists(path) else []

    def read(self, before: int | None = None) -> DataFrame | None:
        """The last committed version (before a number); None if there is none."""
        found = [n for n in self.committed() if before is None or n < before]
        return self.spark.read.parquet(self._version(found[-1])) if found else None

    def write(self, table: DataFrame, number: int) -> None:
        """The version, whole, without its marker."""
        table.write.mode("overwrite").parquet(self._version(number))

    def commit(self, number: int) -> None:
        """From now on the version counts; older ones than the `keep` last are deleted."""
        path, files = self._path("commits", str(number))
        files.create(path, True).close()
        for old in self.committed()[: -self.keep]:
            for part in (("commits", str(old)), ("versions", str(old))):
                gone, where = self._path(*part)
                where.delete(gone, True)

    def apply(self, batch: DataFrame, number: int, merge: Merge) -> bool:
        """The version that merge(previous, batch, number) gives; False if it was committed before."""
        if number in self.committed():
            return False
        previous = self.read(before=number)
        if previous is None:
            raise ValueError("there is no version to start from: write and commit one first")
        self.write(merge(previous, batch, number), number)
        self.commit(number)
        return True


def merged_stream(source: DataFrame, table: Snapshots, merge: Merge, checkpoint: str, first: int = 1):  # noqa: ANN201
    """A started stream that applies micro-batch n of source as version first + n, until its input is drained."""

    def step(batch: DataFrame, number: int) -> None:
        table.apply(batch, first + number, merge)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
