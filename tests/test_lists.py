"""Vectors in lists: nearest neighbours and similar pairs against all pairs."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetlake.functions import expressions as E
from assetlake.operators import faces, graph, lists, vectors

SCHEMA = "image_id long, embedding array<double>"


def clustered(rng, n, dims=24, centres=12, spread=0.05):
    middle = rng.normal(size=(centres, dims))
    out = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    out[n // 2 : n // 2 + n // 10] = out[n // 2]  # a group of copies
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 40)
    monkeypatch.setattr(lists, "PROBES", 7)


def stored(spark, data):
    return spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(data)], SCHEMA)


def asked(spark, data):
    return spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(data)], "query_id long, query array<double>")


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_nearest_against_all(spark, small_blocks, k):
    rng = np.random.default_rng(1)
    data = clustered(rng, 400)
    probes = np.concatenate([data[::40], rng.normal(size=(5, 24)), data[200:202]])
    got = {}
    for r in vectors.top_k(stored(spark, data), asked(spark, probes), k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.image_id, r.distance, r.score))
    for q, probe in enumerate(probes):
        exact = ((data - probe) ** 2).sum(1)
        wanted = np.lexsort((np.arange(len(data)), exact))[:k]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, len(wanted) + 1))
        assert [r[1] for r in rows] == wanted.tolist()
        assert [r[2] for r in rows] == pytest.approx(exact[wanted].tolist()) and [r[3] for r in rows] == pytest.approx((1 / (1 + exact[wanted])).tolist())


def test_lists_out_of_reach_are_skipped(spark):
    data = clustered(np.random.default_rng(2), 1500)
    assert vectors.visited_share(stored(spark, data), asked(spark, data[::100]), 5) < 0.35


def test_no_nested_loop(spark):
    data = clustered(np.random.default_rng(3), 60)
    plan = vectors.top_k(stored(spark, data), asked(spark, data[:3]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_of_nothing(spark):
    data = clustered(np.random.default_rng(4), 30)
    assert vectors.top_k(stored(spark, data).where("false"), asked(spark, data), 3).count() == 0
    assert vectors.top_k(stored(spark, data), asked(spark, data).where("false"), 3).count() == 0


def test_pairs_and_links_against_all(spark, small_blocks):
    rng = np.random.default_rng(5)
    data = np.concatenate([clustered(rng, 300, spread=0.5), np.zeros((3, 24)), rng.normal(size=(40, 24))])
    df = stored(spark, data).withColumnRenamed("image_id", "id")
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-30)
    similar = unit @ unit.T
    wanted = {(a, b) for a in range(len(data)) for b in range(a + 1, len(data)) if similar[a, b] >= 0.82}
    rows = faces.cosine_pairs(df, 0.82).collect()
    assert {(r.a, r.b) for r in rows} == wanted and len(rows) == len(wanted) > 100
    assert all(r.similarity == pytest.approx(similar[r.a, r.b]) for r in rows)
    parts = lambda edges: {tuple(r) for r in graph.connected_components(edges).collect()}
    links = faces.cosine_links(df, 0.82)
    assert parts(links) == parts(spark.createDataFrame(sorted(wanted), "a long, b long"))
    assert links.count() < len(wanted)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [])], "id long, embedding array<double>")
    assert faces.cosine_pairs(df).count() == faces.cosine_links(df).count() == 0


def test_compared_share_of_clustered_faces(spark):
    """Lists that a threshold of 0.82 can't reach are not compared."""
    data = clustered(np.random.default_rng(6), 2000, spread=0.1)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    df = graph.written(spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(unit)], "id long, vector array<double>"))
    points = lists.pivots(df)
    members = lists.dealt(df, points)
    sizes = lists.list_sizes(members).toPandas().set_index("list")
    assert sizes.n.sum() == 2000 and len(sizes) <= len(points) <= lists.MOST_PIVOTS
    far = lists.distances(unit, points)
    reach = np.stack([far[:, e] - sizes.radius[e] <= np.sqrt(2 - 2 * 0.82) for e in sizes.index], axis=1)
    assert (reach * sizes.n.to_numpy()).sum() / 2000**2 < 0.5


def test_a_vector_is_moved_once_for_a_shelf(spark):
    """Of vectors that lie evenly nothing is ruled out; they must not be moved for each list then."""
    data = np.random.default_rng(7).normal(size=(1200, 24))
    df = graph.written(spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(data)], "id long, vector array<double>"))
    points = lists.pivots(df)
    members = lists.dealt(df, points)
    layout = lists.shelved(lists.list_sizes(members).toPandas(), points)
    placed = lists.on_shelves(members, layout).groupBy("shelf").count().toPandas()
    assert placed["count"].sum() == 1200 and placed["count"].max() <= lists.BLOCK and len(placed) <= 2 * lists._SHELVES < len(layout)
    moved = lists.visits(df, points, layout, lambda rows, far: np.ones(far.shape, bool))
    assert moved.count() == 1200 * len(placed)
    assert moved.groupBy("id").sum("lists").where(f"`sum(lists)` >= {len(layout)}").count() == 1200


def test_large_lists_are_cut_and_small_ones_share_a_shelf(spark, monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 40)
    sizes = pd.DataFrame({"list": range(4), "n": [100, 10, 10, 30], "radius": 1.0})
    layout = lists.shelved(sizes, np.array([[0.0], [1.0], [2.0], [3.0]]))
    assert layout[["first", "shelves"]].to_numpy().tolist() == [[0, 3], [3, 1], [3, 1], [4, 1]]


def test_norm_is_worked_out_once_for_a_vector(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<float>")
    unit = rows.select("id", E.l2_normalise(F.col("v")).alias("u"))
    assert {r.id: r.u for r in unit.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}
    wide = spark.range(4).select(F.array_repeat(F.col("id").cast("double"), 3000).alias("v"))
    began = time.perf_counter()
    wide.select(F.sum(F.element_at(E.l2_normalise(F.col("v")), 1))).collect()
    assert time.perf_counter() - began < 10  # 3,000 norms of each would take over half a minute


@pytest.mark.parametrize("threshold", [0.42, 0.82])
def test_links_at_the_edge_of_single_precision(spark, threshold):
    """A product that single precision puts on the wrong side of the threshold is decided in double."""
    turn = lambda c: [c, math.sqrt(1 - c * c)]
    data = [[1.0, 0.0], turn(threshold + 1e-9), [-1.0, 0.0], [-threshold + 1e-9, -math.sqrt(1 - (threshold - 1e-9) ** 2)]]
    found = faces.cosine_links(stored(spark, np.array(data)).withColumnRenamed("image_id", "id"), threshold)
    assert {tuple(sorted((r.a, r.b))) for r in found.collect()} == {(0, 1)}


def test_searches_with_the_same_filters_meet_assets_as_one(spark):
    """Against each search alone, with filters that nothing passes, and pages by time cut where they are found."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(300, 8))
    table = spark.range(300).selectExpr("id", "concat('f', id % 7, '.', if(id % 2 = 0, 'a', 'b')) as filename", "if(id % 2 = 0, 'a', 'b') as extension", "id % 50 as size_bytes", "if(id = 3, null, id % 20) as mtime", "cast(if(id % 11 = 0, 1, null) as bigint) as deleted_at", "1 as root_id", "cast(null as bigint) as taken_at", "1.0D as gps_lat", "1.0D as gps_lng")
    tag_table = spark.createDataFrame([(n, f"t{n}") for n in range(3)], "id long, name string")
    links = spark.range(300).selectExpr("id as image_id", "id % 3 as tag_id", "'ai' as source", "1.0D as score")
    texts = ["x #t1 size:>10b", "#t1 size:>10b", "f3 #t1 size:>10b", "f3 #t2 #t1", "x format:a", "", "f2 #t0 format:b size:<30b"]
    searches = [(n, texts[n % 7], rng.normal(size=8).tolist() if n % 7 in (0, 4) else None) for n in range(28)]
    df = spark.createDataFrame(searches, "query_id long, query string, vector array<double>")
    own = stored(spark, data).where("image_id % 5 != 0")
    found = vectors.hybrid_searches(table, links, tag_table, own, df, 9)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 9), r.source))
    for n, text, vector in searches[:7]:
        alone = vectors.hybrid_search(table, links, tag_table, own, text, vector, 9).collect()
        assert sorted(got.get(n, [])) == sorted((r["rank"], r.id, round(r.score, 9), r.source) for r in alone)
    assert all(sorted(got.get(n, [])) == sorted(got.get(n % 7, [])) for n in range(28) if searches[n][2] is None)
    assert len(got[0]) == len(got[4]) == 9 and 3 not in got


def test_no_pair_of_a_search_and_an_asset_is_shuffled(spark):
    met = spark.range(5000).selectExpr("id % 2 as page", "id", "id as mtime").repartition(3)
    newest = vectors._newest(met, 4)
    assert {(r.page, r.id, r["rank"]) for r in newest.collect()} == {(p, 4998 + p - 2 * n, n + 1) for p in (0, 1) for n in range(4)}
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(page") < plan.index("MapInPandas")  # above it: what tasks keep is dealt out
