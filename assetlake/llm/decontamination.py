"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are grouped into classes by their number of shingles; class ``u``
holds items of ``u/2 < n <= u``. For each class a document is covered by
overlapping windows of ``2u`` shingles that step by ``u``, so that a passage of
up to ``u`` shingles lies inside one window and document length no longer
dilutes the Jaccard similarity: a window that holds 0.8 of an item's shingles
has one of at least 0.19 with it. Each of ``PERMUTATIONS`` minima is a band of
its own; an item and a window that agree in one are candidates (a miss has the
chance 0.81 ** 64, about 1e-6). Candidates are verified by exact containment:
the shingles themselves, as strings, against those of the whole document.

The items are the stated query set. They are searched in blocks of
``ITEMS_PER_BLOCK`` or ``CHARS_PER_BLOCK``, which bounds what a task holds; documents are only
scanned, never shuffled.

Defined cases: null, empty or short (under five words) items and documents have
no shingles and match nothing. Repeated document rows give repeated result
rows; repeated item rows (same id and text) count once, while different texts
under one item id are separate items with a result row each. Items without an
id are left out. Other columns of either table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SHINGLE_WORDS, SIMILARITY

PERMUTATIONS = 64
SMALLEST_CLASS = 1
#: Items of one pass. A block's band keys take 8 bytes x PERMUTATIONS an item: 10 MB.
ITEMS_PER_BLOCK = 20_000
#: Characters of the items of one pass, all of which the driver and every executor hold at once.
CHARS_PER_BLOCK = 16 << 20
_WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def _lower(word: str) -> str:
    low = word.lower()
    return low if len(low) == len(word) and "ς" not in low else "".join(c.lower() if len(c.lower()) == 1 else c for c in word)


def word_shingles(text: str, k: int = SHINGLE_WORDS) -> set[str]:
    """Distinct runs of ``k`` lower-case words, joined by blanks."""
    words = [_lower(w) for w in _WORD.findall(text)]
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def _multipliers() -> np.ndarray:
    return np.random.default_rng(1).integers(1 << 31, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)


def _size_class(n: int) -> int:
    return max(SMALLEST_CLASS, 1 << (n - 1).bit_length())


class _Block:
    """Band keys of a block of items, by size class, with a small table that most windows fail."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, s) for i, t in items if (s := word_shingles(t))]
        a = _multipliers()
        by: dict[int, list] = {}
        for n, (_, _set) in enumerate(self.items):
            by.setdefault(_size_class(len(_set)), []).append(n)
        self.classes = []
        texts = [" ".join(sorted(s)) for _, s in self.items]  # only for hashing each shingle's words
        prints = {}
        for n, h, _, _ in common.hashed(texts):
            # shingles of the joined list at every fifth word are the items' own
            prints[n] = _folded(common.shingles(h)[::SHINGLE_WORDS])
        for u, members in sorted(by.items()):
            keys = np.empty((PERMUTATIONS, len(members)), np.uint32)
            for c, n in enumerate(members):
                with np.errstate(over="ignore"):
                    keys[:, c] = (prints[n][None, :] * a[:, None]).min(axis=1)
            order = np.argsort(keys, axis=1)
            # a table of 64 places an item: one window in 64 passes by chance
            places = (64 * len(members)).bit_length()
            near, bits = np.zeros((PERMUTATIONS, 1 << places), np.bool_), np.uint32(32 - places)
            for j in range(PERMUTATIONS):
                near[j, _scatter(keys[j]) >> bits] = True
            self.classes.append((u, np.take_along_axis(keys, order, 1), np.array(members)[order], near, bits))


def _scatter(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x * np.uint32(0x85EBCA6B)


def _folded(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


def _candidates(prints: np.ndarray, bounds: np.ndarray, block: _Block) -> dict[int, set[int]]:
    """Item numbers by document, for the shingles ``prints`` of documents ``bounds[d]:bounds[d + 1]``."""
    found: dict[int, set[int]] = {}
    a = _multipliers()
    step = block.classes[0][0]
    # rows of `step` shingles; the last of a document repeats its last shingle, which changes no minimum
    lengths = np.diff(bounds)
    rows = -(-lengths // step)
    first = np.concatenate([[0], np.cumsum(rows)])
    owner = np.repeat(np.arange(len(lengths)), rows)
    inner = (np.arange(first[-1]) - first[:-1][owner])[:, None] * step + np.arange(step)[None, :]
    grid = np.ascontiguousarray(prints[bounds[:-1][owner][:, None] + np.minimum(inner, lengths[owner][:, None] - 1)].T)
    for j in range(PERMUTATIONS):
        with np.errstate(over="ignore"):
            low, own = (grid * a[j]).min(axis=0), owner
        size = step
        for u, keys, members, near, bits in block.classes:
            while size < u:  # join neighbours of one document to rows of twice the size
                low, own = _halved(low, own)
                size *= 2
            window = low.copy()
            same = own[1:] == own[:-1]
            window[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])
            hit = np.flatnonzero(near[j, _scatter(window) >> bits])
            if len(hit):
                lo, hi = np.searchsorted(keys[j], window[hit], "left"), np.searchsorted(keys[j], window[hit], "right")
                for w, x, y in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    found.setdefault(int(own[w]), set()).update(members[j, x:y].tolist())
    return found


def _halved(low: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of pairs of rows; pairs start anew in each document."""
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    lead = np.flatnonzero(place % 2 == 0)
    mate = np.minimum(lead + 1, len(own) - 1)
    paired = (own[mate] == own[lead]) & (mate > lead)
    return np.where(paired, np.minimum(low[lead], low[mate]), low[lead]), own[lead]


def _matches(texts: list[str], block: _Block, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    if not block.items:
        return
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> Iterator[tuple[int, int, int, int]]:
        prints = np.concatenate([p for _, p in pending])
        bounds = np.concatenate([[0], np.cumsum([len(p) for _, p in pending])])
        for d, members in _candidates(prints, bounds, block).items():
            own = word_shingles(texts[pending[d][0]])
            for m in sorted(members):
                item, wanted = block.items[m]
                shared = len(wanted & own)
                if shared / len(wanted) >= threshold:
                    yield pending[d][0], item, shared, len(wanted)

    size = 0
    for i, h, _, _ in common.hashed(texts):
        s = common.shingles(h)
        if len(s):
            pending.append((i, _folded(s)))
            size += len(s)
        if size > 100_000:
            yield from flush()
            pending, size = [], 0
    if pending:
        yield from flush()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(document, item) for each item of whose distinct shingles the document holds ``threshold`` or more."""
    spark = docs.sparkSession
    wanted = common.texts_of(items, item_col).withColumnRenamed("doc_id", "item_id").where("item_id is not null and text != ''").distinct()
    size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-size[0] // ITEMS_PER_BLOCK), -(-size[1] // CHARS_PER_BLOCK))
    source = common.texts_of(docs, id_col)
    results = []
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else wanted
        shipped = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.toLocalIterator()])

        def search(rows, shipped=shipped):
            block = _Block(shipped.value)
            for batch in common.batches(rows):
                out = [(batch["doc_id"][d], *rest) for d, *rest in _matches(batch["text"], block, threshold)]
                if out:
                    doc, item, shared, size = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "item_id": pa.array(item, pa.int64()), "shared": pa.array(shared, pa.int64()), "item_shingles": pa.array(size, pa.int64()), "containment": pa.array([a / n for a, n in zip(shared, size, strict=True)], pa.float64())})

        results.append(source.mapInArrow(search, SCHEMA))
    if not results:
        return spark.createDataFrame([], SCHEMA)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents that contain no item; all their columns stay, and so do documents without a text.

    Whether a document goes depends on its text alone, so texts are found by
    their 64-bit hash: ids may be missing or stand in several rows.
    """
    digest, name = F.xxhash64(F.col("text").cast("string")), common.unused(docs, "_digest")
    bad = contaminated(docs.select(digest.alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(name)).distinct()
    bad = common.materialize(bad, "contaminated")
    return docs.withColumn(name, digest).join(common.small(bad, 16), name, "left_anti").select(docs.columns)
