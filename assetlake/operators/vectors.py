"""Vectors of assets: upsert, nearest neighbours, and searches that combine them with filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import backlog, browse, lists, tags
from .graph import written

DEFAULT_HITS, MOST_HITS = 40, 200


def with_dimension(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """``vectors``, failing on the first that has not ``dims`` elements: a batch is taken whole or not at all."""
    right = F.col(column).isNotNull() & (F.size(column) == dims)
    return vectors.withColumn(column, F.when(right, F.col(column)).otherwise(F.raise_error(F.lit(f"a vector has not {dims} elements"))))


def upsert_vectors(old: DataFrame, new: DataFrame, dims: int, key: str = "image_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    checked = with_dimension(new, dims)
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(checked.select(old.columns))


def write_back(assets: DataFrame, vectors: DataFrame, results: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(assets, vectors) after a batch of the embedding model: ``results`` (id, result); an asset without a vector in it has failed, the others are ready and their vectors stored."""
    given = results.where("result is not null").select(F.col("id").alias("image_id"), F.col("result").alias("embedding"))
    judged = results.select("id", "result", F.when(F.col("result").isNull(), F.lit("no vector")).alias("error"))
    fresh = with_dimension(given, dims).select(*(F.col(c) if c in ("image_id", "embedding") else F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in vectors.columns))
    return backlog.merge_results(assets, judged, "embedding"), upsert_vectors(vectors, fresh, dims)


def vector_of(vectors: DataFrame, image_id: int) -> DataFrame:
    return vectors.where(F.col("image_id") == image_id).limit(1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors (image_id, embedding) of every query (query_id, query): (query_id, image_id, distance, score, rank).

    Exact, by squared distances; the score is 1 / (1 + distance). A query first
    visits the lists (see ``lists``) nearest to it that hold ``k`` vectors, whose
    k-th distance is its reach; then all lists that this can reach.
    """
    stored = vectors.select(F.col("image_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = written(queries.select("query_id", F.col("query").cast("array<double>").alias("vector")))
    near = _lists_of(stored)
    if near is None:
        return _ranked(stored.sparkSession.createDataFrame([], _FOUND), k)
    points, members, known = near
    first = written(lists.compared(members, points, known, asked, "query_id", lambda rows, far: _nearest_lists(far, known, k), _nearest(k), _FOUND))
    reach = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "image_id"))).where(F.col("rank") == k)
    reached = written(asked.join(reach.select("query_id", F.sqrt("distance").alias("reach")), "query_id", "left"))
    return _ranked(lists.compared(members, points, known, reached, "query_id", _reached(known), _nearest(k), _FOUND), k)


_FOUND = "query_id long, image_id long, distance double"


def _lists_of(stored: DataFrame):
    """(pivots, members on shelves, layout in the driver: a row for each list), or none without vectors."""
    stored = written(stored)
    points = lists.pivots(stored)
    if not len(points):
        return None
    members = written(lists.dealt(stored, points))
    known = lists.shelved(lists.list_sizes(members).orderBy("list").toPandas(), points)
    return points, lists.on_shelves(members, known), known


def _reached(known: pd.DataFrame):
    """Chooses the lists that a probe's ``reach`` touches; all if it has none."""
    radius = known["radius"].to_numpy()
    return lambda rows, far: far - radius[None, :] <= rows["reach"].fillna(np.inf).to_numpy()[:, None] * (1 + lists.SLACK) + lists.SLACK


def _nearest_lists(far: np.ndarray, known: pd.DataFrame, k: int) -> np.ndarray:
    """For each probe its nearest lists that hold ``k`` vectors together."""
    order = np.argsort(far, axis=1, kind="stable")
    before = np.cumsum(known["n"].to_numpy()[order], axis=1) - known["n"].to_numpy()[order]
    out = np.zeros(far.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out


def _nearest(k: int):
    """The ``k`` nearest members of a shelf for each of its probes, within their ``reach`` if they have one; equal vectors have equal distances, so ids decide."""

    def compare(block: pd.DataFrame, own: np.ndarray, probes: pd.DataFrame, asked: np.ndarray, tiles) -> pd.DataFrame:
        ids = block["id"].to_numpy()
        found = _Best(k, probes["reach"].fillna(np.inf).to_numpy() ** 2 if "reach" in probes else np.full(len(probes), np.inf))
        for held, place in tiles:
            far = lists.distances(asked[place], own[held])
            n = min(k, len(held))
            edge = np.minimum(np.partition(far, n - 1, axis=1)[:, n - 1], np.sqrt(found.bound[place]))
            row, column = np.nonzero(far <= edge[:, None] * (1 + lists.SLACK) + lists.SLACK)
            for at in range(0, len(row), lists.PROBES):
                i, j = place[row[at : at + lists.PROBES]], held[column[at : at + lists.PROBES]]
                found.add(i, ids[j], ((asked[i] - own[j]) ** 2).sum(1))
        row, image, exact = found.rows()
        return pd.DataFrame({"query_id": probes["query_id"].to_numpy()[row], "image_id": image, "distance": exact})

    return compare


class _Best:
    """The ``k`` rows of least (exact, id) of each probe so far; ``bound``: beyond which none can be one of them."""

    #: Rows that are put together at once.
    MOST = 1 << 20

    def __init__(self, k: int, bound: np.ndarray | None = None):
        self.k, self.bound, self.parts, self.pending, self.held = k, bound, [], 0, 0

    def add(self, row: np.ndarray, image: np.ndarray, exact: np.ndarray) -> None:
        self.parts.append((row, image, exact))
        self.pending += len(row)
        if self.pending > self.held + self.MOST:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, image, exact = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((image, exact, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order = order[place < self.k]
        last = place[place < self.k] == self.k - 1
        row, image, exact = row[order], image[order], exact[order]
        if self.bound is not None:
            self.bound[row[last]] = np.minimum(self.bound[row[last]], exact[last])
        self.parts, self.pending, self.held = [(row, image, exact)], len(row), len(row)
        return row, image, exact


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "image_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", 1 / (1 + F.greatest("distance", F.lit(0.0)))).select("query_id", "image_id", "distance", "score", "rank")


def visited_share(vectors: DataFrame, queries: DataFrame, k: int) -> float:
    """Of all pairs of a query and a list, the share that ``top_k`` visits."""
    stored = vectors.select(F.col("image_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    points, _, known = _lists_of(stored)
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("vector"))
    reach = top_k(vectors, queries, k).where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("reach"))
    visited = lists.visits(asked.join(reach, "query_id", "left"), points, known, _reached(known), keep=())
    return visited.agg(F.coalesce(F.sum(F.col("lists")), F.lit(0))).first()[0] / max(1, asked.count() * len(known))


def vector_count(vectors: DataFrame) -> DataFrame:
    """One row: the stored vectors."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"))


def similar_to(vectors: DataFrame, ids: DataFrame, k: int = DEFAULT_HITS) -> DataFrame:
    """Neighbours of stored vectors (ids: image_id), themselves left out; an image without a vector has none."""
    queries = vectors.join(ids.select("image_id").distinct(), "image_id", "left_semi").select(F.col("image_id").alias("query_id"), F.col("embedding").alias("query"))
    found = top_k(vectors, queries, k + 1).where("image_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "image_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# --- search texts with tokens --------------------------------------------------


def _size(token: Column) -> Column:
    """Bytes of 'size:>5MB' and its like; null where it does not parse."""
    number = F.regexp_extract(token, r"(?i)^size:[<>]=?(\d+(?:\.\d+)?)(kb|mb|gb|b)?$", 1)
    unit = F.lower(F.regexp_extract(token, r"(?i)^size:[<>]=?(\d+(?:\.\d+)?)(kb|mb|gb|b)?$", 2))
    times = F.when(unit == "kb", 1024.0).when(unit == "mb", 1024.0**2).when(unit == "gb", 1024.0**3).otherwise(1.0)
    return F.when(number != "", F.round(number.cast("double") * times).cast("long"))


def parse_search(queries: DataFrame) -> DataFrame:
    """Queries (query_id, query) with their parts: text, tags, format, size_min, size_max.

    '#x' is a tag, 'format:x' a format, 'size:>5MB' (or >=, <, <=) a bound, the
    rest is text. A bound that does not parse is ignored; of several the last wins.
    """
    parts = F.filter(F.split(F.trim(F.coalesce("query", F.lit(""))), r"\s+"), lambda x: x != "")
    is_tag = lambda x: x.startswith("#") & (F.length(x) > 1)
    is_format = lambda x: F.lower(x).startswith("format:") & (F.length(x) > 7)
    is_size = lambda x: F.lower(x).startswith("size:")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    bound = lambda sign: last(F.filter(F.transform(F.filter("parts", lambda x: is_size(x) & F.substring(x, 6, 1).eqNullSafe(sign)), _size), lambda x: x.isNotNull()))
    return queries.withColumn("parts", parts).select(
        "query_id",
        F.array_join(F.filter("parts", lambda x: ~is_tag(x) & ~is_format(x) & ~is_size(x)), " ").alias("text"),
        F.array_distinct(F.transform(F.filter("parts", is_tag), lambda x: F.substring(x, 2, 10_000))).alias("tags"),
        last(F.transform(F.filter("parts", is_format), lambda x: E.ascii_lower(F.ltrim(F.substring(x, 8, 10_000), F.lit("."))))).alias("format"),
        bound(">").alias("size_min"),
        bound("<").alias("size_max"),
    )


def hybrid_search(assets: DataFrame, links: DataFrame, tag_table: DataFrame, vectors: DataFrame, text: str, query_vector: list[float] | None, limit: int = DEFAULT_HITS, root_ids: tuple[int, ...] = ()) -> DataFrame:
    """(id, score, source, rank) for one search text, whose filters apply before anything is ranked.

    Without text the filtered assets by time ('dsl', 1.0); with text the nearest
    filtered vectors ('semantic'); if there is none, filtered file names that
    hold the text ('filename', 0.5).
    """
    spark = assets.sparkSession
    limit = min(max(limit, 1), MOST_HITS)
    part = parse_search(spark.createDataFrame([(0, text)], "query_id long, query string")).first()
    p = browse.BrowseParams(root_ids=root_ids, formats=(part["format"],) if part["format"] else (), size_min=part["size_min"], size_max=part["size_max"])
    kept = assets.where(browse.predicate(p))
    if part["tags"]:
        kept = kept.join(tags.images_with_all(links, tag_table, part["tags"]).withColumnRenamed("image_id", "id"), "id", "left_semi")
    newest = Window.orderBy(F.desc("mtime"), F.desc("id"))
    if not part["text"]:
        page = kept.orderBy(F.desc("mtime"), F.desc("id")).limit(limit)
        return page.select("id", F.lit(1.0).alias("score"), F.lit("dsl").alias("source"), F.row_number().over(newest).alias("rank"))
    if query_vector is not None:
        query = spark.createDataFrame([(0, [float(x) for x in query_vector])], "query_id long, query array<double>")
        own = vectors.join(kept.select(F.col("id").alias("image_id")), "image_id", "left_semi")
        found = top_k(own, query, limit).select(F.col("image_id").alias("id"), "score", F.lit("semantic").alias("source"), "rank")
        if not own.isEmpty():
            return found
    page = kept.where(E.contains_literal(F.col("filename"), part["text"])).orderBy(F.desc("mtime"), F.desc("id")).limit(limit)
    return page.select("id", F.lit(0.5).alias("score"), F.lit("filename").alias("source"), F.row_number().over(newest).alias("rank"))


def hybrid_searches(assets: DataFrame, links: DataFrame, tag_table: DataFrame, vectors: DataFrame, searches: DataFrame, limit: int = DEFAULT_HITS) -> DataFrame:
    """``hybrid_search`` for many searches (query_id, query, vector): (query_id, id, score, source, rank).

    Searches with the same filters meet the assets as one; Spark broadcasts the
    distinct filters while they are small. Filters with tags meet only the
    assets that carry the first of them. Vectors meet searches in blocks (see
    ``_filtered``), and a page that goes by time is cut in the task that finds it, so no
    pair of a search and an asset is shuffled or written.
    """
    limit = min(max(limit, 1), MOST_HITS)
    parsed = parse_search(searches).join(searches.select("query_id", "vector"), "query_id")
    parsed = written(parsed.select("query_id", "text", "vector", F.struct(F.array_sort("tags").alias("tags"), "format", "size_min", "size_max").alias("filter")))
    filters = written(parsed.select("filter").distinct().select("filter", F.monotonically_increasing_id().alias("f")))
    asked = written(parsed.join(filters, "filter").select("query_id", "text", "vector", "f"))
    wanted = written(tag_table.select(F.col("id").alias("tag_id"), "name").join(filters.select(F.explode("filter.tags").alias("name")).distinct(), "name"))
    named = links.join(wanted, "tag_id").groupBy(F.col("image_id").alias("id")).agg(F.collect_set("name").alias("names"))
    held = assets.where(E.live()).select("id", "extension", "size_bytes", "mtime", "filename").join(named, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    held = written(held.where("size(names) > 0") if filters.where("size(filter.tags) = 0").isEmpty() else held)

    near = asked.where("text != '' and vector is not null").select("query_id", "f", F.col("vector").cast("array<double>").alias("vector"))
    stored = vectors.where("embedding is not null").select(F.col("image_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    of_near = filters.join(near.select("f").distinct(), "f", "left_semi")
    passed = _passed(held.join(stored.select("id"), "id", "left_semi"), of_near).groupBy("id").agg(F.collect_set("f").alias("filters"))
    found = written(_ranked(_filtered(written(stored.join(passed, "id")), near, limit), limit))
    semantic = found.select("query_id", F.col("image_id").alias("id"), "score", F.lit("semantic").alias("source"), "rank")

    others = asked.where("text = ''").unionByName(asked.where("text != ''").join(found.select("query_id").distinct(), "query_id", "left_anti")).select("query_id", "text", "f")
    pages = written(others.select("text", "f").distinct().withColumn("page", F.monotonically_increasing_id()))
    met = _passed(held, filters.join(pages, "f")).where(F.contains(E.ascii_lower(F.col("filename")), E.ascii_lower(F.col("text"))))
    newest = _newest(met, limit).join(pages.join(others, ["text", "f"]).select("page", "query_id", (F.col("text") == "").alias("plain")), "page")
    by_time = newest.select("query_id", "id", F.when(F.col("plain"), 1.0).otherwise(0.5).alias("score"), F.when(F.col("plain"), "dsl").otherwise("filename").alias("source"), "rank")
    return semantic.unionByName(by_time)


def _passed(held: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``held`` once for each of ``filters`` (filter, ...) that takes them."""
    named = filters.select("*", "filter.*").drop("filter")
    takes = (
        (F.col("format").isNull() | (F.col("extension") == F.col("format")))
        & (F.col("size_min").isNull() | (F.col("size_bytes") >= F.col("size_min")))
        & (F.col("size_max").isNull() | (F.col("size_bytes") <= F.col("size_max")))
        & (F.size(F.array_except("tags", "names")) == 0)
    )
    by_tag = held.withColumn("tag", F.explode("names")).join(named.where("size(tags) > 0").withColumn("first", F.col("tags")[0]), (F.col("tag") == F.col("first")) & takes).drop("tag", "first")
    return by_tag.unionByName(held.join(named.where("size(tags) = 0"), takes))


def _newest(met: DataFrame, limit: int) -> DataFrame:
    """(page, id, rank) of the newest ``limit`` rows of ``met`` (page, id, mtime) of each page; a task keeps no more of a page, so few rows are shuffled."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(limit)
        for part in parts:
            best.add(part["page"].to_numpy(), -part["id"].to_numpy(), part["age"].to_numpy())
        page, image, age = best.rows()
        yield pd.DataFrame({"page": page, "id": -image, "age": age})

    age = F.coalesce(-F.col("mtime"), F.lit((1 << 63) - 1)).alias("age")
    kept = met.select("page", "id", age).mapInPandas(run, "page long, id long, age long")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("age", F.desc("id")))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).drop("age")


def _filtered(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, image_id, distance): the ``k`` nearest of ``stored`` (id, vector, filters) that have its filter, from each block, for each of ``asked`` (query_id, f, vector).

    Blocks of vectors and of searches meet as matrices, a filter at a time.
    """
    blocks, parts, groups = lists.dimensions(stored.count(), asked.count())
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda id, n: F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
    key = ("block", "part")
    left = stored.withColumn("block", block("id", blocks)).withColumn("part", each(parts)).repartition(groups, *key)
    right = asked.withColumn("part", block("query_id", parts)).withColumn("block", each(blocks)).repartition(groups, *key)
    compare, tile = _nearest(k), lists.TILE

    def tiles(block: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place = np.repeat(np.arange(len(block)), block["filters"].map(len))
        number = np.concatenate(block["filters"].to_numpy())
        order = np.argsort(number, kind="stable")
        place, number = place[order], number[order]
        f = rows["f"].to_numpy()
        for one in np.unique(f):
            held = place[np.searchsorted(number, one) : np.searchsorted(number, one, "right")]
            own = np.flatnonzero(f == one)
            step = max(1, tile // max(1, len(held)))
            for at in range(0, len(own) if len(held) else 0, step):
                yield held, own[at : at + step]

    def run(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(rows):
            return pd.DataFrame({"query_id": [], "image_id": [], "distance": []})
        own = lists.matrix(block["vector"])
        return compare(block, own, rows, lists.matrix(rows["vector"], own.shape[1]), tiles(block, rows))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, _FOUND)
