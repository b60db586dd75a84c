"""A table in versions that streams write to, each of their batches once.

A version is a folder of Parquet files that is never changed. A small record
for each version names its folder and, for every stream, the last batch that it
holds. The record is made last and only if there is none of its number yet, so
a job that breaks off leaves the version before, a batch that is replayed finds itself
recorded and changes nothing, and of two writers at once one starts again from the other's version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import backlog, reconcile
from ..operators.graph import written

#: Versions whose files stay, the current one included: readers may be at work on an older one.
KEPT = 3


class VersionedTable:
    """A table at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _records(self) -> list[int]:
        folder = self._place(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def record(self) -> dict | None:
        """The newest version: its number, its folder and the last batch of each stream; none before the first."""
        numbers = self._records()
        if not numbers:
            return None
        stream = self._fs.open(self._place(f"{self.path}/versions/{numbers[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The newest version."""
        now = self.record()
        if now is None:
            raise ValueError(f"there is no version at {self.path}")
        return self.spark.read.parquet(now["data"])

    def _commit(self, record: dict) -> bool:
        """Make the record; false if there is one of its number."""
        try:
            out = self._fs.create(self._place(f"{self.path}/versions/{record['version']}"), False)
        except Py4JJavaError as e:
            if "Exist" in str(e.java_exception):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(record), "utf-8"))
        finally:
            out.close()
        return True

    def write(self, df: DataFrame) -> int:
        """The first version."""
        record = {"version": 1, "data": f"{self.path}/data/{uuid.uuid4().hex}", "batches": {}}
        if not self._records():
            df.write.parquet(record["data"])
            if self._commit(record):
                return 1
        raise ValueError(f"there is a version at {self.path}")

    def change(self, stream: str, batch: int, change: Callable[[DataFrame], DataFrame]) -> bool:
        """One more version by ``change`` of the newest, for a stream's batch; false if a version holds that batch.

        Batches of a stream come in order. ``change`` is called again if another stream was faster.
        """
        while True:
            now = self.record()
            if now["batches"].get(stream, -1) >= batch:
                return False
            after = {"version": now["version"] + 1, "data": f"{self.path}/data/{uuid.uuid4().hex}", "batches": now["batches"] | {stream: batch}}
            change(self.spark.read.parquet(now["data"])).write.parquet(after["data"])
            if self._commit(after):
                self._drop_old(after)
                return True
            self._fs.delete(self._place(after["data"]), True)

    def _drop_old(self, now: dict) -> None:
        """Delete the files of the versions before the last ``KEPT``; their records go too."""
        for number in self._records():
            if number <= now["version"] - KEPT:
                place = self._place(f"{self.path}/versions/{number}")
                stream = self._fs.open(place)
                try:
                    data = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["data"]
                finally:
                    stream.close()
                self._fs.delete(self._place(data), True)
                self._fs.delete(place, False)


def reconcile_into(fired: DataFrame, table: VersionedTable, listing: Callable[[DataFrame], DataFrame], clock: Callable[[], int], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that lists each micro-batch's fired roots (``listing`` of root_id) anew and writes the reconciled catalog, once a batch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        roots = written(df.select("root_id").distinct())  # read several times below; the batch, with its events, would be worked out anew each time
        if not roots.isEmpty():
            table.change("reconcile", batch_id, lambda assets: reconcile.reconcile_roots(assets, listing(roots), roots, clock()))

    return fired.writeStream.queryName(f"reconcile-{uuid.uuid4().hex[:8]}").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def enrich_into(ticks: DataFrame, table: VersionedTable, scorers: dict[str, tuple], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream whose every micro-batch takes one selection off each backlog and writes the enriched catalog, once a batch.

    ``scorers``: step -> (function of a batch, type of its result, column for it or none), see ``backlog.enrich_once``.
    """

    def batch(_: DataFrame, batch_id: int) -> None:
        def change(assets: DataFrame) -> DataFrame:
            for step, (fn, kind, column) in scorers.items():
                assets = backlog.enrich_once(assets, step, fn, kind, column)
            return assets

        table.change("enrich", batch_id, change)

    return ticks.writeStream.queryName(f"enrich-{uuid.uuid4().hex[:8]}").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def tick_rows(events: DataFrame) -> DataFrame:
    """Any stream as one of ticks: its rows don't matter, only that a batch comes."""
    return events.select(F.lit(1).alias("tick"))
