"""Change events of watched folders: routing, debouncing, and what they start."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import written

KINDS = ("create", "modify", "remove")
SECONDS = 1.0


def watched(events: DataFrame) -> DataFrame:
    """Events that change files."""
    return events.where(F.col("kind").isin(*KINDS))


def route_events(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events (path, kind, ts, ...) with the root_id of the first enabled local root that holds them; others are dropped.

    Roots are a small table of its own (folders that someone added); of several
    that hold a path the first by (created_at, id) wins, without a shuffle: each
    event meets all roots as one array.
    """
    usable = roots.where("enabled and type = 'local'").select(F.struct("created_at", "id", "path").alias("r"))
    listed = usable.agg(F.array_sort(F.collect_list("r")).alias("roots"))
    met = events.crossJoin(F.broadcast(listed))
    bare = lambda r: F.regexp_replace(r["path"], r"[\\/]+$", "")
    holds = lambda r: F.startswith(F.col("path"), bare(r)) & F.substring(F.substr(F.col("path"), F.length(bare(r)) + 1), 1, 1).isin("", "/", "\\")
    return met.withColumn("root_id", F.get(F.filter("roots", holds), F.lit(0))["id"]).where("root_id is not null").drop("roots")


def skipped_roots(roots: DataFrame) -> DataFrame:
    """Enabled roots that cannot be watched."""
    return roots.where("enabled and type != 'local'")


#: Length of the pieces of time, in waits, at whose ends a root's events may be dealt to other tasks.
_PIECE = 256
#: Pieces of a part that one task folds; longer parts are folded piece by piece.
_SHORT = 64


def debounce_batch(events: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """(root_id, ts) of the events that fire: per root, at least ``seconds`` after the last that fired.

    Events that do not fire do not prolong the wait. An event that comes at least
    the wait after the one before it always fires, so a root's time is cut there,
    where such a gap falls on the end of a piece of time, and the parts are folded
    apart. A task reads its parts in time order and holds one time. A part
    without gaps that is longer than ``_SHORT`` pieces is folded in many tasks (``_fold_long``).
    """
    span = int(seconds * 1_000_000)
    at = events.select("root_id", F.unix_micros("ts").alias("at")).where("at is not null").withColumn("piece", F.floor(F.col("at") / (span * _PIECE)))
    own = Window.partitionBy("root_id").orderBy("piece")
    pieces = at.groupBy("root_id", "piece").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    new = F.coalesce(F.col("first") - F.lag("last").over(own) >= span, F.lit(True))
    parts = pieces.withColumn("new", new.cast("int")).select("root_id", "piece", "first", F.sum("new").over(own).alias("part"))
    parts = written(parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("root_id", "part"))))
    most = parts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    named = parts.select(F.col("root_id").alias("of_root"), F.col("piece").alias("of_piece"), "part", "n")
    placed = at.join(named, F.col("root_id").eqNullSafe(F.col("of_root")) & (F.col("piece") == F.col("of_piece"))).select("root_id", "part", "piece", "n", "at")
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.where(F.col("n") <= _SHORT).repartition(tasks, "root_id", "part").sortWithinPartitions("root_id", "part", "at").select("root_id", "part", "at")

    def fold(batches):
        of, last = None, None
        for batch in batches:
            keys = list(zip(batch.column("root_id").to_pylist(), batch.column("part").to_pylist(), strict=True))
            times, fired = batch.column("at").to_pylist(), []
            for n, (key, t) in enumerate(zip(keys, times, strict=True)):
                if key != of or t - last >= span:
                    fired.append(n)
                    of, last = key, t
            yield batch.select(["root_id", "at"]).take(pa.array(fired, pa.int64()))

    fired = dealt.mapInArrow(fold, dealt.select("root_id", "at").schema)
    if most > _SHORT:
        fired = fired.unionByName(_fold_long(placed.where(F.col("n") > _SHORT).drop("n"), span, most))
    return fired.select("root_id", F.timestamp_micros("at").alias("ts"))


def _fold_long(placed: DataFrame, span: int, most: int) -> DataFrame:
    """(root_id, at) of what fires in parts (root_id, part, piece, at) of at most ``most`` neighbouring pieces each.

    Where a piece is entered decides all that fires in it, and it is entered
    within its first wait or at the next event. For each such entry a piece gives
    its last firing, hence the entry of the next piece. Which entries are met
    from a part's first event on is found by doubling: jumps of one piece, of two,
    of four and so on. Then every piece is folded from its own entry.
    """
    times = written(placed.distinct().withColumn("root", F.struct("root_id")))  # a struct, so that null roots meet too
    key = ("root", "part", "piece")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["at"].to_numpy())
        jump = np.append(np.searchsorted(t, t + span), len(t))
        last = np.arange(len(t) + 1)
        while (jump < len(t)).any():
            last, jump = np.where(jump < len(t), last[jump], last), jump[jump]
        begin = int(pdf["piece"].iloc[0]) * _PIECE * span + span
        n = min(int(np.searchsorted(t, begin)) + 1, len(t))
        return pd.DataFrame({"root_id": [pdf["root_id"].iloc[0]] * n, "part": pdf["part"].iloc[0], "piece": pdf["piece"].iloc[0], "entry": t[:n], "last": t[last[:n]]})

    kind = {f.name: f.dataType.simpleString() for f in times.schema.fields}
    entries = times.groupBy(*key).applyInPandas(ends, f"root_id {kind['root_id']}, part {kind['part']}, piece {kind['piece']}, entry long, last long")
    entries = written(entries.withColumn("root", F.struct("root_id")))
    after = entries.select("root", "part", (F.col("piece") + 1).alias("piece"), (F.col("last") + span).alias("x"), F.col("entry").alias("of"))
    here = entries.select("root", "part", "piece", F.col("entry").alias("x"), F.lit(None).cast("long").alias("of"))
    order = Window.partitionBy(*key).orderBy("x", F.col("of").isNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = after.unionByName(here).withColumn("to", F.first(F.when(F.col("of").isNull(), F.col("x")), ignorenulls=True).over(order)).where("of is not null and to is not null")
    jumps = written(met.select("root", "part", (F.col("piece") - 1).alias("piece"), F.col("of").alias("entry"), "to"))
    first = entries.groupBy("root", "part").agg(F.min(F.struct("piece", "entry")).alias("first"))
    seen = written(first.select("root", "part", "first.piece", "first.entry"))
    length = 1
    while length < most:
        reached = seen.join(jumps, [*key, "entry"]).select("root", "part", (F.col("piece") + length).alias("piece"), F.col("to").alias("entry"))
        seen = written(seen.unionByName(reached))
        onward = jumps.select("root", "part", (F.col("piece") - length).alias("piece"), F.col("entry").alias("to"), F.col("to").alias("on"))
        jumps = written(jumps.join(onward, [*key, "to"]).select(*key, "entry", F.col("on").alias("to")))
        length *= 2

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["at"].to_numpy())
        n, fired = int(np.searchsorted(t, pdf["entry"].iloc[0])), []
        while n < len(t):
            fired.append(int(t[n]))
            n = int(np.searchsorted(t, t[n] + span))
        return pd.DataFrame({"root_id": [pdf["root_id"].iloc[0]] * len(fired), "at": fired})

    return times.join(seen, [*key]).groupBy(*key).applyInPandas(fold, f"root_id {kind['root_id']}, at long")


class _Debounce(StatefulProcessor):
    """Keeps the last fired time (microseconds) of a root."""

    def __init__(self, seconds: float):
        self.span = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        times = sorted(t for part in rows for t in part["at"].tolist())
        fired = []
        for t in times:
            if last is None or t - last >= self.span:
                fired.append(t)
                last = t
        if fired:
            self.last.update((last,))
            yield pd.DataFrame({"root_id": key[0], "at": fired})

    def close(self) -> None:
        pass


def debounce(events: DataFrame, seconds: float = SECONDS, watermark: str = "10 seconds") -> DataFrame:
    """The stream form of ``debounce_batch`` over events with ``root_id`` and ``ts``; state is one time per root.

    Events are taken in time order within a micro-batch; one that is older than
    a fired event does not fire.
    """
    timed = events.withWatermark("ts", watermark).select("root_id", F.unix_micros("ts").alias("at"))
    fired = timed.groupBy("root_id").transformWithStateInPandas(statefulProcessor=_Debounce(seconds), outputStructType="root_id bigint, at bigint", outputMode="Append", timeMode="None")
    return fired.select("root_id", F.timestamp_micros("at").alias("ts"))


def start_reconcile(fired: DataFrame, reconcile: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "1 second") -> StreamingQuery:
    """Call ``reconcile(roots, batch_id)`` with the distinct roots that fired in each micro-batch (see ``reconcile.reconcile_roots``)."""

    def batch(df: DataFrame, batch_id: int) -> None:
        reconcile(df.select("root_id").distinct(), batch_id)

    return fired.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def start_enrichment(ticks: DataFrame, enrich: Callable[[int], None], checkpoint: str, trigger: str = "2 seconds") -> StreamingQuery:
    """Call ``enrich(batch_id)`` at each tick: it takes one selection off each automatic backlog (embedding, tag; see ``backlog.enrich_once``)."""
    return ticks.writeStream.foreachBatch(lambda _, batch_id: enrich(batch_id)).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
