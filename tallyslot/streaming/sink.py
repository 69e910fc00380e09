"""A keyed result that a stream keeps up to date and that can be read while the stream runs.

Each trigger writes its changed rows into a folder of its own. After every few
triggers they are merged, newest row per key, into one base; what an earlier base
has replaced is deleted one merge later, so that a reader which has just listed
the folders can finish. A result thus holds at most two bases and the changes of
two merges, however long the stream runs, and a reader reads one base and the
changes since.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Triggers between two merges.
EVERY = 16
BASE, CHANGES, COMPLETE = "base", "changes", "_complete"


class KeyedSink:
    def __init__(self, spark: SparkSession, home: str, schema: StructType, keys: list[str], every: int = EVERY):
        self.spark, self.home, self.schema, self.keys, self.every = spark, home, schema, keys, every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(home).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _finished(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind, ascending."""
        root = self._path(f"{self.home}/{kind}")
        if not self._fs.exists(root):
            return []
        found = [entry.getPath() for entry in self._fs.listStatus(root)]
        return sorted(int(p.getName()) for p in found if self._fs.exists(self._path(p, COMPLETE)))

    def _put(self, rows: DataFrame, kind: str, number: int) -> None:
        """Write a folder whole and mark it; an unfinished folder of that number is replaced."""
        path = f"{self.home}/{kind}/{number}"
        rows.write.mode("overwrite").parquet(path)
        self._fs.create(self._path(f"{path}/{COMPLETE}"), True).close()

    def _newest(self, base: int | None, upto: int) -> DataFrame:
        parts = [] if base is None else [(BASE, base)]
        parts += [(CHANGES, n) for n in self._finished(CHANGES) if (base is None or n > base) and n <= upto]
        frames = [
            self.spark.read.schema(self.schema).parquet(f"{self.home}/{kind}/{n}").withColumn("_batch", F.lit(n).cast("long")) for kind, n in parts
        ]
        if not frames:
            return self.spark.createDataFrame([], self.schema)
        values = [c for c in self.schema.names if c not in self.keys]
        newest = reduce(DataFrame.unionByName, frames).groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*self.schema.names)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Take one trigger's rows, one per key. A batch that is replayed replaces its own rows, or changes nothing once merged."""
        bases = self._finished(BASE)
        if bases and batch <= bases[-1]:
            return
        self._put(rows.select(*self.schema.names), CHANGES, batch)
        if (batch + 1) % self.every:
            return
        self._put(self._newest(bases[-1] if bases else None, batch), BASE, batch)
        if bases:
            for n in bases[:-1]:
                self._fs.delete(self._path(f"{self.home}/{BASE}/{n}"), True)
            for n in self._finished(CHANGES):
                if n <= bases[-1]:
                    self._fs.delete(self._path(f"{self.home}/{CHANGES}/{n}"), True)

    def read(self) -> DataFrame:
        """The newest row of each key over all finished triggers."""
        bases, changes = self._finished(BASE), self._finished(CHANGES)
        return self._newest(bases[-1] if bases else None, max([*bases, *changes], default=-1))
