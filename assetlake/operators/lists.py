"""Vectors in lists: what the triangle inequality rules out is never compared, the rest as matrices.

Pivots are a bounded sample of the vectors (``pivots``), of which each vector
takes the nearest; a list's radius is the distance of its farthest member. A probe at
distance d from a pivot is at least d - radius away from all of its list, so it
visits only the lists whose bound it can reach. Neighbouring lists stand on a
shelf, and a list that holds too many vectors is cut into shelves by a hash of
the id; what visits a shelf is dealt into parts. A shelf and a part meet in one
group, whose sizes are bounded, and a probe is moved once for each shelf that it
visits, however many lists stand there: inside the group only the lists that it can
reach are compared with it. All of it is exact; how much is ruled out depends on how
the vectors lie (of vectors that lie evenly in many dimensions, nothing is).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most pivots, and so the bound of what is sent to each task about them.
MOST_PIVOTS = 1024
#: Most vectors of a shelf and most probes of a part, on average.
BLOCK, PROBES = 32_768, 32_768
#: Few vectors are put on so many shelves, if these hold ``_LEAST``, and meet in so many groups, so that all cores have work.
_SHELVES, _GROUPS, _LEAST = 8, 64, 256
#: Distances that a task holds at once, and rows whose distances from all pivots it does.
TILE, ROWS = 1 << 22, 2048
#: Room for rounding in comparisons of distances: near 0 they are right to the root of a double's precision only.
SLACK = 1e-6


def matrix(column: pd.Series, dims: int | None = None) -> np.ndarray:
    """Rows of a column of arrays, in double."""
    rows = column.to_numpy()
    if dims is not None and any(r is None or len(r) != dims for r in rows):
        raise ValueError(f"a vector has another number of elements than {dims}")
    return np.stack([np.asarray(r, np.float64) for r in rows])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` from those of ``b``, up to rounding."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def pivots(vectors: DataFrame, most: int = MOST_PIVOTS) -> np.ndarray:
    """About as many distinct vectors of ``vectors`` (id, vector) as the root of their number, at most ``most``: those with the least hashes."""
    n = min(most, max(1, math.isqrt(vectors.count())))
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(n).select("vector").toPandas()  # at most ``most`` rows
    return np.unique(matrix(rows["vector"]), axis=0) if len(rows) else np.zeros((0, 0))


def dealt(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """(id, vector, list, far): each vector's nearest pivot and its distance from it."""
    shared = vectors.sparkSession.sparkContext.broadcast(points)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            for at in range(0, len(part), ROWS):
                rows = part.iloc[at : at + ROWS]
                far = distances(matrix(rows["vector"], own.shape[1]), own)
                best = far.argmin(1)
                yield pd.DataFrame({"id": rows["id"].to_numpy(), "vector": rows["vector"].to_numpy(), "list": best, "far": far[np.arange(len(rows)), best]})

    return vectors.select("id", "vector").mapInPandas(run, "id long, vector array<double>, list int, far double")


def list_sizes(members: DataFrame) -> DataFrame:
    """(list, n, radius), a row for each list that has members."""
    return members.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))


def _chain(points: np.ndarray) -> np.ndarray:
    """The points in an order in which each is followed by the nearest of those that are left."""
    far = distances(points, points)
    order, left = [0], np.ones(len(points), bool)
    while len(order) < len(points):
        left[order[-1]] = False
        order.append(int(np.where(left, far[order[-1]], np.inf).argmin()))
    return np.array(order)


def shelved(sizes: pd.DataFrame, points: np.ndarray) -> pd.DataFrame:
    """``sizes`` (list, n, radius; a row for each list) with the first shelf of each list and the number of its shelves; ordered by shelf."""
    out = sizes.iloc[_chain(points[sizes["list"].to_numpy()])].reset_index(drop=True)
    most = min(BLOCK, max(_LEAST, math.ceil(int(out["n"].sum()) / _SHELVES)))
    first, count, last, room = [], [], -1, 0
    for n in out["n"].tolist():
        new = 0 if n <= room else math.ceil(n / most)
        room = room - n if not new else most - n if new == 1 else 0
        first.append(last + 1 if new else last)
        count.append(max(new, 1))
        last += new
    return out.assign(first=np.array(first, np.int32), shelves=np.array(count, np.int32))


def on_shelves(members: DataFrame, layout: pd.DataFrame) -> DataFrame:
    """``members`` with their shelf."""
    known = members.sparkSession.createDataFrame(layout[["list", "first", "shelves"]], "list int, first int, shelves int")  # a row for each list, of which there are at most MOST_PIVOTS
    return members.join(F.broadcast(known), "list").withColumn("shelf", F.col("first") + F.pmod(F.xxhash64("id"), F.col("shelves")).cast("int")).drop("first", "shelves")


#: Takes probes' rows and their distances (probe, list) from the pivots, in the order of the layout; tells which lists they visit.
Choose = Callable[[pd.DataFrame, np.ndarray], np.ndarray]


def visits(probes: DataFrame, points: np.ndarray, layout: pd.DataFrame, choose: Choose, since: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``probes`` (with a column ``vector``) once for each shelf with lists that ``choose`` picks, with the number of these as ``lists``.

    Shelves before the one in the column ``since`` are not visited; of a probe's columns only those of ``keep`` are returned.
    """
    place = np.repeat(np.arange(len(layout)), layout["shelves"])
    number = np.concatenate([np.arange(a, a + n) for a, n in zip(layout["first"], layout["shelves"], strict=True)])
    shelf, start = np.unique(number, return_index=True)
    shared = probes.sparkSession.sparkContext.broadcast((points[layout["list"].to_numpy()], place, shelf.astype(np.int32), start))
    fields = [f for f in probes.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, place, shelf, start = shared.value
        for part in parts:
            for at in range(0, len(part), ROWS):
                rows = part.iloc[at : at + ROWS]
                chosen = choose(rows, distances(matrix(rows["vector"], own.shape[1]), own))
                met = np.add.reduceat(chosen[:, place], start, axis=1, dtype=np.int32)
                if since is not None:
                    met[shelf[None, :] < rows[since].to_numpy()[:, None]] = 0
                row, column = np.nonzero(met)
                for some in range(0, len(row), ROWS):
                    r, c = row[some : some + ROWS], column[some : some + ROWS]
                    yield rows[names].iloc[r].assign(shelf=shelf[c], lists=met[r, c])

    return probes.mapInPandas(run, T.StructType([*fields, T.StructField("shelf", T.IntegerType()), T.StructField("lists", T.IntegerType())]))


def dimensions(vectors: int, probes: int) -> tuple[int, int, int]:
    """(blocks, parts, tasks) for vectors and probes that all meet."""
    blocks = max(1, math.ceil(vectors / min(BLOCK, max(_LEAST, math.ceil(vectors / _SHELVES)))))
    parts = max(1, math.ceil(probes / min(PROBES, max(_LEAST, math.ceil(probes / math.ceil(_GROUPS / blocks))))))
    return blocks, parts, min(4096, 2 * blocks * parts)


#: Takes a shelf's members, their vectors, a part's probes, their vectors, and tiles (members' places, probes' places) of what is to be compared.
Compare = Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]], pd.DataFrame]


def compared(members: DataFrame, points: np.ndarray, layout: pd.DataFrame, probes: DataFrame, name: str, choose: Choose, compare: Compare, schema: str, since: str | None = None) -> DataFrame:
    """What ``compare`` returns for each shelf of ``members`` (see ``on_shelves``) and each part of the probes that visit it (see ``visits``); ``name`` tells probes apart."""
    spark = members.sparkSession
    met = visits(probes, points, layout, choose, since, (name,)).groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row for each shelf
    most = min(PROBES, max(_LEAST, math.ceil(met["n"].max() / math.ceil(_GROUPS / len(met))))) if len(met) else PROBES
    met["parts"] = np.ceil(met["n"] / most).astype(np.int32)
    known = F.broadcast(spark.createDataFrame(met[["shelf", "parts"]], "shelf int, parts int"))
    groups = int(min(4096, max(1, 2 * met["parts"].sum())))
    of_each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    key = ("shelf", "part")
    left = members.join(known, "shelf").withColumn("part", of_each).drop("parts").repartition(groups, *key)
    right = visits(probes, points, layout, choose, since).drop("lists").join(known, "shelf").withColumn("part", F.pmod(F.xxhash64(name), F.col("parts")).cast("int")).drop("parts").repartition(groups, *key)
    shared = spark.sparkContext.broadcast((points[layout["list"].to_numpy()], layout["list"].to_numpy()))
    tile = TILE

    def tiles(block: pd.DataFrame, rows: pd.DataFrame, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, number = shared.value
        order = np.argsort(block["list"].to_numpy(), kind="stable")
        held, start = np.unique(block["list"].to_numpy()[order], return_index=True)
        at_list = np.argsort(number)[np.searchsorted(np.sort(number), held)]
        chosen = np.concatenate([choose(rows.iloc[at : at + ROWS], distances(asked[at : at + ROWS], own))[:, at_list] for at in range(0, len(rows), ROWS)])
        for n, places in enumerate(np.split(order, start[1:])):
            visiting = np.flatnonzero(chosen[:, n])
            step = max(1, tile // len(places))
            for at in range(0, len(visiting), step):
                yield places, visiting[at : at + step]

    def run(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(rows):
            return empty.copy()
        asked = matrix(rows["vector"])
        return compare(block, matrix(block["vector"]), rows, asked, tiles(block, rows, asked))

    empty = spark.createDataFrame([], schema).toPandas()
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)
