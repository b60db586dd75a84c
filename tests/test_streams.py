"""Streams that end in tables, and the folder source: against batch results, over restarts and replays."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetlake import schemas
from assetlake.operators import backlog, reconcile
from assetlake.sources import files, folder
from assetlake.streaming import events, tables


def asset(spark, rows):
    """Assets (id, root_id, rel_path, size_bytes) with the values of fresh rows."""
    df = spark.createDataFrame(rows, "id long, root_id long, rel_path string, size_bytes long")
    given = {k: F.lit(v) for k, v in schemas.FRESH.items()} | {"mtime": F.lit(5), "indexed_at": F.lit(1), "filename": F.col("rel_path"), "extension": F.lit("png")}
    return df.select(*(given.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ASSETS))


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive


def test_versions(spark, tmp_path):
    table = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.write(spark.range(3)) == 1
    with pytest.raises(ValueError, match="there is a version"):
        table.write(spark.range(3))
    add = lambda df: df.unionByName(spark.range(0))
    assert table.change("a", 0, add) and not table.change("a", 0, add) and table.change("b", 0, lambda df: df.where("id > 0")) and table.change("a", 1, lambda df: df)
    assert sorted(r.id for r in table.read().collect()) == [1, 2] and table.record()["batches"] == {"a": 1, "b": 0}
    assert len(os.listdir(tmp_path / "t" / "data")) == tables.KEPT


def test_two_writers_at_once(spark, tmp_path):
    table = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    table.write(spark.range(2))
    calls = []

    def slow(df):
        calls.append(1)
        if len(calls) == 1:  # another stream is faster
            table.change("other", 0, lambda d: d.unionByName(spark.range(10, 11)))
        return df.unionByName(spark.range(20, 21))

    assert table.change("mine", 0, slow) and len(calls) == 2
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 10, 20]


def test_reconcile_stream_equals_batch_over_restart_and_replay(spark, tmp_path):
    start = asset(spark, [(1, 1, "a.png", 10), (2, 1, "b.png", 20), (3, 2, "c.png", 30), (4, 3, "d.png", 40)])
    table = tables.VersionedTable(spark, f"file://{tmp_path}/catalog")
    table.write(start)
    listed = spark.createDataFrame([(1, "a.png", "a.png", "png", 11, 5), (1, "new.png", "new.png", "png", 1, 5), (2, "c.png", "c.png", "png", 30, 5), (3, "e.png", "e.png", "png", 9, 5)], "root_id long, rel_path string, filename string, extension string, size_bytes long, mtime long")
    source = tmp_path / "events"
    schema = "root_id long, kind string, ts timestamp"
    stream = lambda: events.debounce(events.watched(spark.readStream.schema(schema).json(f"file://{source}")))
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    put = lambda rows: spark.createDataFrame(rows, "root_id long, kind string, ts string").coalesce(1).write.mode("append").json(f"file://{source}")
    begin = lambda: tables.reconcile_into(stream(), table, lambda roots: listed.join(roots, "root_id", "left_semi"), lambda: 100, f"file://{tmp_path}/ck", availableNow=True)
    put([(1, "modify", at(1)), (1, "modify", at(1)), (2, "other", at(2))])
    run(begin())
    first = table.record()
    assert first["version"] == 2
    put([(3, "create", at(5)), (2, "modify", at(6))])
    run(begin())  # a restart goes on
    assert table.record()["version"] == 3
    roots = spark.createDataFrame([(1,), (2,), (3,)], "root_id long")
    wanted = reconcile.reconcile_roots(reconcile.reconcile_roots(start, listed, roots.where("root_id = 1"), 100), listed, roots.where("root_id > 1"), 100)
    key = lambda df: sorted(map(tuple, df.select("id", "root_id", "rel_path", "size_bytes", "thumb_status", "deleted_at").collect()))
    assert key(table.read()) == key(wanted)
    done = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for name in (str(done), f".{done}.crc"):  # as if the driver had died before it noted the batch
        os.remove(tmp_path / "ck" / "commits" / name)
    run(begin())
    assert table.record()["version"] == 3 and key(table.read()) == key(wanted)


def test_enrichment_stream(spark, tmp_path):
    ready = asset(spark, [(n, 1, f"{n}.png", n) for n in range(40)]).withColumn("thumb_status", F.lit("ready"))
    table = tables.VersionedTable(spark, f"file://{tmp_path}/catalog")
    table.write(ready)

    def text(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["id"]].assign(result=[f"t{i}" for i in rows["id"]])

    scorers = {"tag": (text, "string", "ocr_text"), "embedding": (text, "string", None)}
    source = tmp_path / "ticks"
    spark.range(1).selectExpr("id as n").write.json(f"file://{source}")
    ticks = tables.tick_rows(spark.readStream.schema("n long").json(f"file://{source}"))
    run(tables.enrich_into(ticks, table, scorers, f"file://{tmp_path}/ck", availableNow=True))
    wanted = ready
    for step, (fn, kind, column) in scorers.items():
        wanted = backlog.enrich_once(wanted, step, fn, kind, column)
    key = lambda df: sorted(map(tuple, df.select("id", "tag_status", "embedding_status", "ocr_text").collect()))
    assert key(table.read()) == key(wanted) and table.read().where("tag_status = 'ready'").count() == 40


@pytest.fixture
def pictures(tmp_path):
    top = tmp_path / "pics"
    for name in ("a.png", "b.JPG", "sub/c.webp", "sub/deep/d.jpeg", "sub/e f+g%.png", "notes.txt", "sub/noext"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"x" * len(name))
    return top


def test_listing_equals_scan(spark, pictures):
    spark.dataSource.register(folder.FolderSource)
    got = spark.read.format("asset_folder").option("root_id", 7).load(str(pictures))
    columns = ["root_id", "rel_path", "filename", "extension", "size_bytes", "mtime"]
    wanted = files.scan_assets(spark, 7, f"file://{pictures}").select(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert got.rdd.getNumPartitions() == 3  # a part for each folder


def test_changes_as_a_stream_over_a_restart(spark, pictures, tmp_path):
    spark.dataSource.register(folder.FolderSource)
    out = f"file://{tmp_path}/seen"

    def step():
        time.sleep(0.2)
        df = spark.readStream.format("asset_folder").option("root_id", 7).load(str(pictures)).select("rel_path", "kind")
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(once=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    first = step()
    assert {r for r in first if r[1] == "modify"} == {(p, "modify") for p in ("a.png", "b.JPG", "sub/c.webp", "sub/deep/d.jpeg", "sub/e f+g%.png")}
    (pictures / "sub/c.webp").write_bytes(b"changed")
    (pictures / "a.png").unlink()
    second = step()
    for r in first:
        second.remove(r)
    assert set(second) == {("sub/c.webp", "modify"), (".", "remove")}
    assert len(step()) == len(first) + len(second)
