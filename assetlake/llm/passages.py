"""Repeated passages: every run of ``LEAST_WORDS`` words and more that occurs twice, wherever lines begin and end.

A text is one sequence of words. Its windows of ``LEAST_WORDS`` words are never
all dealt out: a window holds ``HELD`` runs of ``RUN_WORDS`` words, and the
least run of each window is an anchor (winnowing, so equal windows share one).
Only documents with an anchor that occurs twice go on, and of them only the
windows with such anchors; those are counted by their hashes over all
documents, which decides exactly. Neighbouring windows that repeat the same
place form a span.

Defined cases: null and empty texts and those under ``LEAST_WORDS`` words have
no passages; case and what stands between words do not matter; passages that
repeat inside one text count, also where the places overlap; repeated rows
repeat their passages, and those at the same first place all stay; rows with a
null id sort first; extra columns are ignored; an empty table gives no rows.
Rows are told apart by a number of their own, so each row of a shared id has its spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAST_WORDS = 50
RUN_WORDS = 20
#: Runs in a window.
HELD = LEAST_WORDS - RUN_WORDS + 1


def _lows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, the least run of each window); none for under ``LEAST_WORDS`` words."""
    runs = common.shingles(h, RUN_WORDS)
    return (runs, common.sliding(runs, HELD, np.minimum)) if len(runs) >= HELD else (runs[:0], runs[:0])


def _anchors(h: np.ndarray) -> np.ndarray:
    """The runs that are the least of a window, each as often as it occurs."""
    runs, low = _lows(h)
    edge = np.zeros(HELD - 1, np.uint64)
    return runs[common.sliding(np.concatenate([edge, low, edge]), HELD, np.maximum) == runs] if len(low) else runs


def _anchor_rows(batches):
    """(doc_id, run) of all anchors."""
    for batch in common.batches(batches):
        ids, runs = [], []
        for i, h, _, _ in common.hashed(batch["text"]):
            own = _anchors(h)
            ids += [batch["doc_id"][i]] * len(own)
            runs.append(own)
        if ids:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "run": pa.array(np.concatenate(runs).view(np.int64))})


def _window_rows(batches):
    """(row, doc_id, word, start, stop, passage) of the windows whose anchor is one of the document's ``runs``.

    Rows whose id stands in others too are numbered by task; of the others the id is enough.
    """
    number = TaskContext.get().partitionId() << 40
    for batch in common.batches(batches):
        for i, h, starts, ends in common.hashed(batch["text"]):
            number += 1
            word = np.flatnonzero(np.isin(_lows(h)[1], np.array(batch["runs"][i], np.int64).view(np.uint64)))
            if not len(word):
                continue
            out = {"row": pa.array(np.full(len(word), number if batch["several"][i] else 0)), "doc_id": pa.array([batch["doc_id"][i]] * len(word), pa.int64()), "word": pa.array(word, pa.int64())}
            out |= {"start": pa.array(starts[word], pa.int64()), "stop": pa.array(ends[word + LEAST_WORDS - 1], pa.int64())}
            yield pa.RecordBatch.from_pydict(out | {"passage": pa.array(common.shingles(h, LEAST_WORDS)[word].view(np.int64))})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, word, start, stop, n_words, source_doc, source_word, keep) of each passage that occurs more than once.

    ``start`` and ``stop`` are code points of the text; the passage has the
    same words as ``n_words`` words from ``source_word`` on in ``source_doc``,
    where it occurs first by (doc_id, word); ``keep`` marks that place. A place
    that repeats several sources has a span for each; these may overlap.
    """
    texts = common.texts_of(docs)
    anchors = common.materialize(texts.mapInArrow(_anchor_rows, "doc_id long, run long"), "anchors")
    often = common.materialize(anchors.groupBy("run").count().where("count > 1").select("run"), "repeated-anchors")
    own = anchors.join(common.small(often), "run", "left_semi").groupBy("doc_id").agg(F.collect_set("run").alias("runs"))
    shared_ids = texts.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("several"))
    own = own.join(shared_ids, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(F.col("doc_id").alias("id"), "runs", F.coalesce("several", F.lit(False)).alias("several"))
    own = common.materialize(own, "anchors-by-text")
    common.discard(anchors)
    same = F.col("id").eqNullSafe(F.col("doc_id"))
    wanted = texts.join(common.small(own.select("id")), same, "left_semi").join(own, same).select("doc_id", "text", "runs", "several")
    windows = wanted.mapInArrow(_window_rows, "row long, doc_id long, word long, start long, stop long, passage long")
    alike = Window.partitionBy("passage")
    placed = windows.withColumns({"n": F.count(F.lit(1)).over(alike), "lead": F.min(F.struct("doc_id", "word")).over(alike)}).where("n > 1")
    placed = placed.select("row", "doc_id", "word", "start", "stop", F.col("lead.doc_id").alias("source_doc"), (F.col("word") - F.col("lead.word")).alias("shift"))
    key = ("row", "doc_id", "source_doc", "shift")
    run = Window.partitionBy(*key).orderBy("word")
    placed = placed.withColumn("span", F.col("word") - F.row_number().over(run))
    spans = placed.groupBy(*key, "span").agg(F.min("word").alias("word"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("word").alias("last"))
    keep = F.col("source_doc").eqNullSafe(F.col("doc_id")) & (F.col("shift") == 0)
    return spans.select("doc_id", "word", "start", "stop", (F.col("last") - F.col("word") + LEAST_WORDS).alias("n_words"), "source_doc", (F.col("word") - F.col("shift")).alias("source_word"), keep.alias("keep"))
