"""Albums as boxes against a loop over all assets."""

import json
import random

import numpy as np
import pytest

from assetlake.operators import boxes, browse

SCHEMA = "id long, root_id long, filename string, extension string, size_bytes long, mtime long, taken_at long, gps_lat double, gps_lng double, deleted_at long"


def takes(f, a):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    shown = a["taken_at"] if a["taken_at"] is not None else a["mtime"]
    return (
        (f.get("includeDeleted") or a["deleted_at"] is None)
        and (not f.get("rootIds") or a["root_id"] in f["rootIds"])
        and (not f.get("formats") or a["extension"] in [low(x.lstrip(".")) for x in f["formats"]])
        and low((f.get("q") or "").strip()) in low(a["filename"])
        and a["size_bytes"] is not None
        and a["size_bytes"] >= max(0, f.get("sizeMin") or 0)
        and (f.get("sizeMax") is None or a["size_bytes"] <= max(0, f["sizeMax"]))
        and (f.get("takenFrom") is None or (shown is not None and shown >= f["takenFrom"]))
        and (f.get("takenTo") is None or (shown is not None and shown <= f["takenTo"]))
        and (f.get("hasGps") is None or f["hasGps"] == (a["gps_lat"] is not None and a["gps_lng"] is not None))
    )


def random_assets(rng, n):
    for i in range(n):
        size = rng.choice((None, 0, 500, 500, rng.randrange(2000), -5))
        yield dict(id=i, root_id=rng.choice((1, 2, 3, None)), filename=rng.choice(("IMG_%d.png", "cat%d.jpg", "É%d")) % i, extension=rng.choice(("png", "jpg", "a|b", None)), size_bytes=size, mtime=rng.choice((None, rng.randrange(1000))), taken_at=rng.choice((None, rng.randrange(1000))), gps_lat=rng.choice((None, 1.5)), gps_lng=2.5, deleted_at=rng.choice((None, None, 4)))


def random_filter(rng):
    parts = {
        "rootIds": rng.choice(([], [1], [1, 3, 3], [9])), "formats": rng.choice(([], [".PNG"], ["jpg", ".a|b"], ["*"])), "q": rng.choice((None, None, None, " img_", "É")), "sizeMin": rng.choice((None, 0, 500, -3, rng.randrange(2000))),
        "sizeMax": rng.choice((None, 500, 0, -1, rng.randrange(2000))), "takenFrom": rng.choice((None, rng.randrange(1000))), "takenTo": rng.choice((None, rng.randrange(1000))), "hasGps": rng.choice((None, True, False)), "includeDeleted": rng.choice((None, True, False)),
    }
    return {k: v for k, v in parts.items() if v is not None and rng.random() < 0.6}


@pytest.mark.parametrize("cells", [1, 4, 64])
def test_members_and_counts_against_a_loop(spark, cells, monkeypatch):
    monkeypatch.setattr(boxes, "MEMBER_CELLS", cells)
    monkeypatch.setattr(boxes, "COUNT_CELLS", cells)
    rng = random.Random(cells)
    assets = list(random_assets(rng, 300))
    filters = [random_filter(rng) for _ in range(150)] + [{}]
    table = spark.createDataFrame([tuple(a.values()) for a in assets], SCHEMA)
    albums = spark.createDataFrame([(n, f"a{n}", json.dumps(f)) for n, f in enumerate(filters)], "id long, name string, filter_json string")
    wanted = {(n, a["id"]) for n, f in enumerate(filters) for a in assets if takes(f, a)}
    rows = [tuple(r) for r in browse.album_members(table, albums).collect()]
    assert set(rows) == wanted and len(rows) == len(wanted)
    assert {r.album_id: r.members for r in browse.album_counts(table, albums).collect()} == {n: sum(x == n for x, _ in wanted) for n in range(len(filters))}


def test_no_nested_loop_and_nothing(spark):
    table = spark.createDataFrame([tuple(a.values()) for a in random_assets(random.Random(9), 50)], SCHEMA)
    albums = spark.createDataFrame([(1, "all", "{}"), (2, "big", '{"sizeMin": 5}')], "id long, name string, filter_json string")
    for df in (browse.album_members(table, albums), browse.album_counts(table, albums)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [r.members for r in browse.album_counts(table.where("false"), albums).collect()] == [0, 0]
    assert browse.album_members(table, albums.where("false")).count() == 0


def test_counts_meet_no_pairs_and_strips_are_dealt_out(spark, monkeypatch):
    for name, value in (("COUNT_CELLS", 3), ("ASSETS", 25), ("BOXES", 20)):
        monkeypatch.setattr(boxes, name, value)
    rng = random.Random(8)
    assets = list(random_assets(rng, 300))
    filters = [random_filter(rng) for _ in range(120)] + [{"q": "img_"}, {"q": "img_1", "sizeMin": 400}, {"takenFrom": 300, "takenTo": 310}]
    table = spark.createDataFrame([tuple(a.values()) for a in assets], SCHEMA)
    albums = spark.createDataFrame([(n, json.dumps(f)) for n, f in enumerate(filters)], "id long, filter_json string")
    found = boxes.counts(table, albums)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "FlatMapCoGroupsInArrow" in plan  # only prefix sums are looked up
    assert {r.album_id: r.members for r in found.collect()} == {n: got for n, f in enumerate(filters) if (got := sum(takes(f, a) for a in assets))}


def test_points_in_many_boxes_against_a_loop():
    rng = np.random.default_rng(3)
    key, x, y = rng.integers(0, 3, 400), np.sort(rng.integers(0, 50, 400)), rng.integers(0, 37, 400)
    asks, left, above = rng.integers(0, 4, 90), rng.integers(0, 52, 90), rng.integers(0, 40, 90)
    right, below = left + rng.integers(-3, 30, 90), above + rng.integers(-3, 30, 90)
    wanted = [sum((key == k) & (x >= a) & (x < b) & (y >= c) & (y < d)) for k, a, b, c, d in zip(asks, left, right, above, below, strict=True)]
    assert boxes._in_boxes(key, x, y, asks, left, right, above, below).tolist() == wanted
    assert boxes._in_boxes(key, x, y, asks[:2], left[:2], right[:2], above[:2], below[:2]).tolist() == wanted[:2]
    assert boxes._in_boxes(key[:0], x[:0], y[:0], asks, left, right, above, below).tolist() == [0] * 90
