"""Substring dedup: passages that repeat, exactly or nearly, across documents.

A text is one sequence of words, line breaks are only blanks. It is cut into
paragraphs where the words themselves say so: a paragraph begins at a word that,
hashed with the next one, has the least value of the ``REACH`` words on either
side. So a passage is cut alike wherever it stands, whatever surrounds it, and
one of 50 words holds whole paragraphs. Every word belongs to a paragraph; cuts
lie more than ``REACH`` words apart and from a text's ends, so short rests belong
to their neighbours.

Equal word sequences are one class. Each class has MinHash bands over its
five-word shingles; ``tune_bands`` picks rows and bands for a high recall at the
threshold. The classes that collide in a band are compared with each other by
their exact Jaccard similarity, large buckets in tiles (``links.exact_links``).
Components of the verified links are the groups of repeats: the first occurrence by (doc_id, paragraph) stays, the others are to be
removed. Neighbouring paragraphs that repeat form a span; spans of fewer than
``LEAST_WORDS`` words are stock phrases, not passages, and are not reported.

Defined cases: null and empty texts have no paragraphs; texts under
``2 * REACH`` words are one paragraph, those under five words one shingle; long
texts are taken whole; a run of one repeated word has no cut in it; repeated rows
are documents of their own that repeat all of each other; rows with a null id
sort first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, links
from .common import SHINGLE_WORDS, SIMILARITY

REACH = 10
LEAST_WORDS = 20
RECALL = 0.999
MOST_MINIMA = 16


def tune_bands(threshold: float = SIMILARITY, recall: float = RECALL, most: int = MOST_MINIMA) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false collisions, that reach ``recall`` at ``threshold`` with ``most`` minima."""
    for rows in range(most, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def paragraph_starts(h: np.ndarray, first: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Numbers of the words that begin a paragraph, for texts of the words ``first[t]:first[t + 1]`` of ``h``."""
    begins = np.unique(first[:-1][np.diff(first) > 0])
    if len(h) < 2:
        return begins
    # zeros around each text are less than any word, so that no cut lies within reach of an end
    place = np.arange(len(h)) + reach * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    x = np.zeros(len(h) + reach * len(first), np.uint64)
    x[place[:-1]] = common.shingles(h, 2) | np.uint64(1)
    x[place[first[1:][np.diff(first) > 0] - 1]] = 0
    low = common.sliding(x, reach, np.minimum)
    own = x[place]
    cut = (own > 0) & (own < low[place - reach]) & (own <= low[np.minimum(place + 1, len(low) - 1)])
    return np.union1d(begins, np.flatnonzero(cut))


def _paragraphs(batches: Iterator) -> Iterator:
    """(row, doc_id, paragraph, start, stop, n_words, node, shingles); ``shingles`` only where a batch has the node first."""
    for batch in common.slices(batches):
        h, starts, ends, first = common.hashed_together(batch.column("text").to_pylist())
        begin = paragraph_starts(h, first)
        if not len(begin):
            continue
        after = np.append(begin[1:], len(h))
        size = after - begin
        text = np.searchsorted(first, begin, "right") - 1
        with np.errstate(over="ignore"):
            place = (np.arange(len(h)) - np.repeat(begin, size)).astype(np.uint64)
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(common.mix(h ^ common.mix(place, 7), 3), out=total[1:])
            node = common.mix((total[after] - total[begin]) ^ size.astype(np.uint64), 11)
        new = np.zeros(len(node), bool)
        new[np.unique(node, return_index=True)[1]] = True
        count = np.where(new, np.maximum(size - SHINGLE_WORDS + 1, 1), 0)
        offset = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(offset[-1]) - np.repeat(offset[:-1] - begin, count)
        value = np.repeat(node, count)  # a paragraph under five words is one shingle of all its words
        whole = np.repeat(size >= SHINGLE_WORDS, count)
        value[whole] = common.shingles(h)[at[whole]]
        value = (value >> np.uint64(32)).astype(np.uint32)
        buffers = [pa.py_buffer(np.packbits(new, bitorder="little")), pa.py_buffer((4 * offset).astype(np.int32)), pa.py_buffer(value)]
        texts = pa.array(text)
        yield pa.RecordBatch.from_pydict(
            {
                "row": batch.column("row").take(texts),
                "doc_id": batch.column("doc_id").take(texts),
                "paragraph": pa.array((np.arange(len(begin)) - np.searchsorted(begin, first[text])).astype(np.int32)),
                "start": pa.array(starts[begin], pa.int64()),
                "stop": pa.array(ends[after - 1], pa.int64()),
                "n_words": pa.array(size, pa.int64()),
                "node": pa.array(node.view(np.int64)),
                "shingles": pa.Array.from_buffers(pa.binary(), len(node), buffers),
            }
        )


def _shingles_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit shingles of a binary column without nulls, and the first of each row (and of all)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return data.view(np.uint32), (at - at[0]) // 4


def _bands(batches: Iterator) -> Iterator:
    """(band, node): the band keys of each class."""
    bands, rows = tune_bands()
    a = np.random.default_rng(10).integers(1 << 31, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    for batch in common.slices(batches):
        node = batch.column("node").to_numpy(zero_copy_only=False)
        s, first = _shingles_of(batch.column("shingles"))
        if not len(node):
            continue
        with np.errstate(over="ignore"):
            for b in range(bands):
                key = np.full(len(node), b, np.uint64)
                for r in range(rows):
                    key = common.mix(key ^ np.minimum.reduceat(s * a[b * rows + r], first[:-1]).astype(np.uint64), r)
                yield pa.RecordBatch.from_pydict({"band": pa.array(key.view(np.int64)), "node": pa.array(node)})


def _sets(batches: Iterator) -> Iterator:
    """(grp, node, weight, set): the distinct shingles of each class."""
    for batch in common.slices(batches):
        s, first = _shingles_of(batch.column("shingles"))
        sets = [np.unique(s[a:b]).astype(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"grp": batch.column("grp"), "node": batch.column("node"), "weight": pa.array(np.ones(len(sets), np.int64)), "set": pa.array(sets, pa.list_(pa.int64()))})


def _similar_classes(classes: DataFrame) -> DataFrame:
    """(node, component) of the classes (node, shingles; copies of a row do no harm) that are linked to others."""
    banded = classes.mapInArrow(_bands, "band long, node long")
    collided = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("band")
    collided = common.materialize(collided, "collisions")
    buckets = common.materialize(banded.join(common.small(collided, 16), "band").distinct(), "buckets")
    wanted = common.materialize(buckets.select("node").distinct(), "colliding")
    own = classes.join(common.small(wanted, 16), "node", "left_semi").dropDuplicates(["node"])
    sets = buckets.select(F.col("band").alias("grp"), "node").join(own, "node").select("grp", "node", "shingles")
    sets = sets.mapInArrow(_sets, "grp long, node long, weight long, set array<long>")
    _, forest = links.exact_links(common.materialize(sets, "paragraph-sets"))
    return common.materialize(links.components(forest, "repeats"), "repeats")


def _repeats(texts: DataFrame, least_words: int, inside: bool) -> DataFrame:
    """The rows of ``repeated_paragraphs`` for texts (row, doc_id, text), with the row."""
    schema = "row long, doc_id long, paragraph int, start long, stop long, n_words long, node long, shingles binary"
    units = common.materialize(texts.mapInArrow(_paragraphs, schema), "paragraphs")
    joined = _similar_classes(units.where("shingles is not null").select("node", "shingles"))
    # a class that repeats stands at two places at least; those of one document count only if asked for
    place = F.col("row") if not inside else F.struct("row", "paragraph")
    classes = units.groupBy("node").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    classes = classes.join(joined, "node", "left").where("low != high or component is not null").select("node", F.coalesce("component", "node").alias("grp"), "low", "high")
    classes = common.materialize(classes, "repeat-classes")
    groups = classes.groupBy("grp").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("grp")
    table = common.materialize(classes.join(common.small(groups), "grp").select("node", "grp"), "repeat-table")
    found = common.materialize(units.drop("shingles").join(common.small(table), "node").drop("node"), "repeated")
    leads = found.groupBy("grp").agg(F.min(F.struct("doc_id", "row", "paragraph")).alias("lead"))
    run = F.col("paragraph") - F.row_number().over(Window.partitionBy("row").orderBy("paragraph"))
    span = Window.partitionBy("row", "run")
    spans = found.withColumn("run", run).withColumns({"span_start": F.min("start").over(span), "span_stop": F.max("stop").over(span), "span_words": F.sum("n_words").over(span)})
    out = spans.where(F.col("span_words") >= least_words).join(leads, "grp")
    keep = F.expr("lead.row = row and lead.paragraph = paragraph")
    return out.select("row", "doc_id", "paragraph", "start", "stop", "n_words", F.concat_ws(":", "lead.doc_id", "lead.paragraph").alias("group_id"), keep.alias("keep"), "span_start", "span_stop", "span_words")


def repeated_paragraphs(docs: DataFrame, least_words: int = LEAST_WORDS, inside: bool = False) -> DataFrame:
    """(doc_id, paragraph, start, stop, n_words, group_id, keep, span_start, span_stop, span_words) of each paragraph that repeats.

    Offsets are code points of the text, ``group_id`` names a group by its first
    occurrence (doc_id:paragraph), ``keep`` marks that one. A group repeats if it
    has places in several documents; with ``inside``, several places anywhere.
    """
    return _repeats(common.texts_of(docs).withColumn("row", F.monotonically_increasing_id()), least_words, inside).drop("row")


def _without(text: pd.Series, cuts: pd.Series) -> pd.Series:
    """Texts without the places ``cuts``, a flat list of starts and stops in order; what stands up to the next word goes too."""

    def kept(t: str | None, c: np.ndarray | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for start, stop in zip(c[::2], c[1::2], strict=True):
            out.append(t[at:start])
            at = stop
            while at < len(t) and not t[at].isalnum():
                at += 1
        return "".join([*out, t[at:]])

    return pd.Series([kept(t, c) for t, c in zip(text, cuts, strict=True)], dtype=object)


def removed(docs: DataFrame, least_words: int = LEAST_WORDS, inside: bool = False) -> DataFrame:
    """The documents without the paragraphs that are not to be kept; all rows and columns stay, ``n_chars`` follows.

    Rows are told apart by a key of their own, so rows that share an id keep
    what is theirs. A null text stays null.
    """
    keyed, key = common.with_key(docs, "keyed-documents")
    texts = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = common.unused(keyed, "_cut")
    spans = _repeats(texts, least_words, inside).where("not keep")
    cuts = spans.groupBy(F.col("row").alias(key)).agg(F.flatten(F.sort_array(F.collect_set(F.array("start", "stop")))).alias(cut))
    marked = keyed.join(common.small(common.materialize(cuts, "cuts"), 200), key, "left")
    touched = F.col(cut).isNotNull()
    kept = F.pandas_udf(_without, "string")(F.when(touched, F.col("text")), F.col(cut))  # untouched texts don't go to Python
    out = marked.withColumn("text", F.when(touched, kept).otherwise(F.col("text"))).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
