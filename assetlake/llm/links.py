"""Links between sets: connected components, and exact Jaccard links inside candidate groups.

Both run on Spark whatever the size of a group: components by alternating star
steps over an edge table, links by tiles of a group's members. A tile gives
counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Set elements that a block of a group's members should hold.
BLOCK_ELEMENTS = 400_000
#: Members of a block, on average.
BLOCK_MEMBERS = 512
#: Sets of a tile that is compared together with others.
_FEW = 16


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of the ``edges`` (a long, b long); a component is named by its least node.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of them, until nothing changes (a logarithmic number of rounds).
    Degrees are only ever aggregated, so a node with many neighbours is no
    single task's work; every round is written to the shared folder.
    """
    spark = edges.sparkSession
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = common.materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(rounds):
        around = both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.materialize(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a != b").distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = common.materialize(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        stats = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (now, large):
            common.discard(old)
        now = after
        if stats == before:
            break
        before = stats
    else:
        raise RuntimeError(f"the components have not settled in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def intersections(members: np.ndarray, elements: np.ndarray, n: int) -> np.ndarray:
    """(n, n) sizes of the intersections of ``n`` sets given as (member, element) pairs without repeats.

    Frequent elements go through a matrix product, rare ones through shifted
    comparisons of the sorted pairs, so neither the number of elements nor one
    common element makes it slow.
    """
    order = np.lexsort((members, elements))
    m, e = members[order], elements[order]
    new = np.concatenate([[True], e[1:] != e[:-1]]) if len(e) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(e)))
    rank = np.cumsum(new) - 1
    out = np.zeros((n, n), np.float32)
    often = max(8, n // 16)
    frequent = np.flatnonzero(size >= often)
    for at in range(0, len(frequent), 4096):
        part = frequent[at : at + 4096]
        column = np.full(len(size), -1)
        column[part] = np.arange(len(part))
        own = column[rank] >= 0
        dense = np.zeros((n, len(part)), np.float32)
        dense[m[own], column[rank[own]]] = 1
        out += dense @ dense.T
    keep = (size < often)[rank] if len(size) else new
    m, rank = m[keep], rank[keep]
    flat = np.zeros(n * n, np.int64)
    for shift in range(1, often):
        same = np.flatnonzero(rank[shift:] == rank[:-shift])
        if not len(same):
            break
        a, b = m[same], m[same + shift]
        flat += np.bincount(a * n + b, minlength=n * n) + np.bincount(b * n + a, minlength=n * n)
    return out.astype(np.int64) + flat.reshape(n, n)


def _small_tiles(tile: np.ndarray, sizes: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared) of all pairs of sets of one tile that share elements; tiles of few sets, all at once."""
    n = len(tile)
    member = np.repeat(np.arange(n), sizes)
    order = np.lexsort((member, elements, tile[member]))
    m, e = member[order], elements[order]
    same_tile = tile[m]
    codes = []
    for shift in range(1, _FEW + 1):
        at = np.flatnonzero((e[shift:] == e[:-shift]) & (same_tile[shift:] == same_tile[:-shift]))
        if not len(at):
            break
        codes.append(m[at] * n + m[at + shift])
    if not codes:
        return (np.zeros(0, np.int64),) * 3
    pair, shared = np.unique(np.concatenate(codes), return_counts=True)
    return pair // n, pair % n, shared


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number that each of ``n`` reaches over the links."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compared(rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, other, links, copies) of whole tiles, rows (tile, node, block, same, weight, set) sorted by tile."""
    if not rows.num_rows:
        return
    tile, node, block, weight = (rows.column(c).to_numpy() for c in ("tile", "node", "block", "weight"))
    same = rows.column("same").to_numpy()
    sets = rows.column("set").combine_chunks()
    sizes, elements = np.asarray(sets.value_lengths()).astype(np.int64), np.asarray(sets.flatten())
    first = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
    left, right = [], []

    def keep(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> None:
        """Pairs at the threshold; pairs inside a block belong to that block's own tile."""
        own = (shared / (sizes[a] + sizes[b] - shared) >= threshold) & (same[a] | (block[a] != block[b]))
        left.append(a[own])
        right.append(b[own])

    count = np.diff(edge)
    few = np.repeat(count <= _FEW, count)
    chosen = np.flatnonzero(few)
    if len(chosen):
        a, b, shared = _small_tiles(tile[chosen], sizes[chosen], elements[np.repeat(few, sizes)])
        keep(chosen[a], chosen[b], shared)
    for t in np.flatnonzero(count > _FEW):
        at, n = edge[t], count[t]
        shared = intersections(np.repeat(np.arange(n), sizes[at : at + n]), elements[first[at] : first[at + n]], n)
        a, b = np.nonzero(np.triu(shared, 1))
        keep(a + at, b + at, shared[a, b])
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return
    n = len(tile)
    links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    copies = np.bincount(a, weight[b], minlength=n) + np.bincount(b, weight[a], minlength=n)
    label = _joined(n, a, b)
    found, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
    nothing = np.zeros(len(moved), np.int64)
    yield pa.RecordBatch.from_pydict(
        {
            "node": pa.array(np.concatenate([node[found], node[moved]])),
            "other": pa.array(np.concatenate([node[found], node[label[moved]]])),
            "links": pa.array(np.concatenate([links[found], nothing]).astype(np.int64)),
            "copies": pa.array(np.concatenate([copies[found], nothing]).astype(np.int64)),
        }
    )


def _compare(threshold: float):
    """Task function over rows sorted by tile: a tile that goes on in the next batch waits for it."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            last = int(np.searchsorted(tile == tile[-1], True)) if len(tile) else 0
            if held and len(tile) and held[-1].column("tile")[-1].as_py() != tile[-1]:
                yield from _compared(pa.Table.from_batches([*held, batch.slice(0, last)]), threshold)
                held = []
            elif last and not held:
                yield from _compared(pa.Table.from_batches([batch.slice(0, last)]), threshold)
            held.append(batch.slice(last) if len(tile) else batch)
        if held:
            yield from _compared(pa.Table.from_batches(held), threshold)

    return run


def exact_links(members: DataFrame, threshold: float = common.SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All pairs with a Jaccard similarity of ``threshold`` or more inside the groups of ``members``.

    ``members``: (grp long, node long, weight long, set array<long>, without
    repeats). A node may be in several groups; if its links are to be counted,
    it must be in one. Groups are cut into blocks by a hash of
    the node, as many as keep a block near BLOCK_ELEMENTS and BLOCK_MEMBERS;
    every pair of blocks is a tile of its own, so each pair of nodes is compared
    once, and a large group becomes many tasks. Tasks read tiles in order, one
    at a time. Returns (node, links, copies): the numbers of linked nodes and of
    their weights; and forest edges (a, b) with the same components as all the links.
    """
    spark = members.sparkSession
    common.bounded_batches(spark)
    sized = members.groupBy("grp").agg(F.sum(F.size("set")).alias("elements"), F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("elements") / BLOCK_ELEMENTS), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int")
    sized = common.materialize(sized.select("grp", blocks.alias("blocks")), "groups")
    placed = members.join(common.small(sized), "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    i, j = F.least("block", "mate"), F.greatest("block", "mate")
    tiles = placed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("grp", i, j).alias("tile"), "node", "block", (F.col("block") == F.col("mate")).alias("same"), "weight", "set"
    )
    tiles = tiles.repartition(common.tasks(spark), "tile").sortWithinPartitions("tile")
    done = common.materialize(tiles.mapInArrow(_compare(threshold), "node long, other long, links long, copies long"), "links")
    counts = done.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    return counts, done.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b"))
