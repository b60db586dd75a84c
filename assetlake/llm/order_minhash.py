"""Document fingerprints by order MinHash.

The k-mers of a text are its runs of ``K`` words, numbered by occurrence so that
repeats stay apart. For each of ``SKETCHES`` hash functions the ``L`` numbered
k-mers with the smallest values are selected, put back into text order and
hashed as a tuple; the fingerprint is the list of the tuples' hashes. The
likeness of two fingerprints is the share of equal places, which estimates the
edit similarity of the texts: k-mers that are moved keep their set but not their
order, unlike under MinHash.

Words are runs of letters and numbers; the characters between two words go into
the hash of the word before, so that texts that differ only there differ too.

Defined cases: a null text counts as empty; texts of fewer than ``K`` words have
one k-mer of all their words, and of none at all an empty k-mer; a text with
fewer than ``L`` k-mers takes those it has. Equal texts have equal
fingerprints. The next document of a row is the next row by (doc_id, text), so
repeated rows follow one another; after the last comes the first, and a single
row follows itself. Rows with a null id come first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SKETCHES = 64
K = 2
L = 2
_ROWS = 16
#: Ranges of neighbouring documents, unless there are more shuffle partitions. Rows of a range are streamed.
MOST_RANGES = 4096
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _multipliers() -> np.ndarray:
    return np.random.default_rng(9).integers(1 << 31, 1 << 32, SKETCHES, dtype=np.uint32) | np.uint32(1)


def _kmers(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
    """Hashes of the numbered k-mers in text order."""
    if not len(h):
        return np.array([zlib.crc32(text.encode("utf-8", "surrogatepass"))], np.uint64)
    gaps = np.append(starts[1:], len(text)) - ends
    plain = gaps == 1
    if not plain.all():  # anything but one character between words: hash it
        h = h.copy()
        with np.errstate(over="ignore"):
            for i in np.flatnonzero(~plain):
                h[i] += np.uint64(zlib.crc32(text[ends[i] : ends[i] + gaps[i]].encode("utf-8", "surrogatepass")))
    s = common.shingles(h, min(K, len(h)))
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(s))
    number = np.empty(len(s), np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return common.mix(s + common.mix(number, 5))


def _sketches(groups: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (documents, SKETCHES) of the numbered k-mers of several texts."""
    keys = np.concatenate(groups)
    sizes = np.array([len(g) for g in groups])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # columns of _ROWS k-mers each, never of two texts; minima run down the columns
    blocks = -(-sizes // _ROWS)
    start = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    owner = np.repeat(np.arange(len(groups)), blocks)
    at = (first[owner] + (np.arange(len(owner)) - start[owner]) * _ROWS)[None, :] + np.arange(_ROWS)[:, None]
    spare = np.nonzero(at >= (first + sizes)[owner][None, :])
    at[spare] = first[owner[spare[1]]]
    short = (keys >> np.uint64(32)).astype(np.uint32)[at]
    out = np.empty((len(groups), SKETCHES), np.uint32)
    top = np.uint32((1 << 32) - 1)
    for j, a in enumerate(_multipliers()):
        with np.errstate(over="ignore"):
            value = short * a
        value[spare] = top
        low = value.min(axis=0)
        place = np.full((L, len(groups)), -1)  # a missing k-mer comes first
        for n in range(L):
            least = np.minimum.reduceat(low, start)
            column = np.flatnonzero(low == np.repeat(least, blocks))
            if len(column) > len(groups):  # of equal values the first column of a text
                column = column[np.concatenate([[True], owner[column][1:] != owner[column][:-1]])]
            row = value[:, column].argmin(axis=0)
            place[n] = np.where(least == top, -1, at[row, column])
            value[row, column] = top
            low[column] = value[:, column].min(axis=0)
        place.sort(axis=0)  # text order
        h = np.full(len(groups), j, np.uint64)
        for p in place:
            h = common.mix(h ^ np.where(p < 0, np.uint64(0), keys[p]))
        out[:, j] = h.astype(np.uint32)
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprint of each text as a row of ``SKETCHES`` 32-bit hashes."""
    out = np.empty((len(texts), SKETCHES), np.uint32)
    pending: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, h, s, e in common.hashed(texts):
        pending.append((i, _kmers(h, s, e, texts[i])))
        size += len(pending[-1][1])
        if size > 1 << 16:
            out[[n for n, _ in pending]] = _sketches([k for _, k in pending])
            pending, size = [], 0
    if pending:
        out[[n for n, _ in pending]] = _sketches([k for _, k in pending])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of rows of fingerprints."""
    return (a == b).mean(axis=1)


def _hex(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many first ones of ``following`` (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row, without moving any text."""

    def rows(batches):
        for batch in common.batches(batches):
            prints = fingerprints(batch["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(batch["doc_id"], pa.int64()), "fingerprint": pa.array([_hex(p) for p in prints], pa.string())})

    return common.texts_of(docs).mapInArrow(rows, "doc_id long, fingerprint string")


def _in_order(batches: Iterator) -> Iterator[tuple]:
    """(range, doc_id, text, ghost) rows."""
    for batch in common.batches(batches):
        yield from zip(batch["part"], batch["doc_id"], batch["text"], batch["ghost"], strict=True)


def _neighbours(batches: Iterator) -> Iterator:
    """Results of each row that is no ghost, from sorted rows of whole ranges."""
    held: list[tuple[int, str]] = []  # rows of one range that wait for the one after
    size = 0

    def results(rows: list[tuple[int, str]]) -> Iterator:
        """Of all ``rows`` but the last."""
        texts = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        both = fingerprints(texts + changed)
        plain, new = both[: len(texts)], both[len(texts) :]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([i for i, _ in rows[:-1]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                "fingerprint": pa.array([_hex(p) for p in plain[:-1]], pa.string()),
                "edited_fingerprint": pa.array([_hex(p) for p in new], pa.string()),
                "near_edited": pa.array(likeness(plain[:-1], new), pa.float64()),
                "near_next": pa.array(likeness(plain[:-1], plain[1:]), pa.float64()),
            }
        )

    current, closed = None, False
    for part, doc_id, text, ghost in _in_order(batches):
        if part != current:
            if len(held) > 1:
                yield from results(held)
            held, size, current, closed = [], 0, part, False
        if closed:
            continue
        held.append((doc_id, text))
        size += len(text)
        closed = ghost  # the first row of the next range, there only to be looked at
        if size > 1 << 20 and len(held) > 1:
            yield from results(held)
            held, size = held[-1:], len(text)
    if len(held) > 1:
        yield from results(held)


def edit_sensitivity(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document.

    Documents are dealt out by ranges of ids and sorted within them; each range
    also gets the first row of the one after it (the last range that of the
    first), so no task depends on another and nothing is sorted as a whole. The
    driver sees the bounds of the ranges only.
    """
    spark = docs.sparkSession
    rows = common.texts_of(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    partitions = common.tasks(spark)
    ranges = min(8 * partitions, max(partitions, MOST_RANGES))
    cuts = rows.agg(F.percentile_approx("at", [n / ranges for n in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("long")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), "right"))

    firsts = rows.select("at").groupBy(range_of("at").alias("part")).agg(F.min("at").alias("first")).sort("part").collect()
    parts, first = np.array([r["part"] for r in firsts], np.int64), np.array([r["first"] for r in firsts], np.int64)

    @F.pandas_udf("array<long>")
    def ranges_of(at: pd.Series) -> pd.Series:
        """The row's range, and the one before (as -1 - range) for a range's first id."""
        n = np.searchsorted(parts, np.searchsorted(cuts, at.to_numpy(), "right"))
        before = -1 - parts[n - 1]
        return pd.Series([[parts[i], b] if f else [parts[i]] for i, b, f in zip(n, before, first[n] == at.to_numpy(), strict=True)])

    placed = rows.withColumn("part", F.explode(ranges_of("at")))
    placed = placed.select(F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")).alias("part"), (F.col("part") < 0).alias("ghost"), "at", "doc_id", "text")
    dealt = placed.repartition(partitions, "part").sortWithinPartitions("part", "ghost", "at", "text")
    return dealt.select("part", "doc_id", "text", "ghost").mapInArrow(_neighbours, _SCHEMA)
