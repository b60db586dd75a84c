"""What only larger tables show: multiplied rows meet by shuffles, whatever Spark's estimate; halves and ties go as in SQL."""

import hashlib
import re
from pathlib import Path

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from assetlake.operators import backlog, boxes, fingerprint, tags
from assetlake.plans import registry as Q, state_queries, views  # noqa: F401  they register
from assetlake.streaming import tables


def inner_broadcasts(df) -> list[str]:
    """Inner joins of the plan, as first made, that send one side through the driver."""
    return re.findall(r"BroadcastHashJoin \[.*Inner.*", df._jdf.queryExecution().executedPlan().toString())


def test_band_keys_are_not_broadcast(spark):
    own = spark.range(2_000).select("id", F.xxhash64(F.floor(F.col("id") / 2)).bitwiseXOR(F.col("id") % 2).alias("dhash"))
    pairs = fingerprint.hamming_pairs(own, 5)
    assert not inner_broadcasts(pairs) and pairs.count() == 1_000
    found = fingerprint.hamming_search(own, own.where("id % 20 = 0").select(F.col("id").alias("probe_id"), "dhash"), 7)
    assert not inner_broadcasts(found) and found.count() == 200


@pytest.fixture
def half_balances(tmp_path):
    """A folder with albums whose balances end in a half, just above the sizes of orders."""
    Path(tmp_path, "orders.parquet").symlink_to(f"{SF}/orders.parquet")
    near = f"select row_number() over (order by o_orderkey) as id, round(o_totalprice)::bigint // 20 * 2 + 0.5::double as balance from '{SF}/orders.parquet' where round(o_totalprice)::bigint % 20 < 10 limit 60"
    duckdb.sql(f"copy (select id as s_suppkey, 's' as s_name, (id % 25)::int as s_nationkey, balance as s_acctbal from ({near})) to '{tmp_path}/supplier.parquet'")
    duckdb.sql(f"copy (select id as c_custkey, 'c' as c_name, (id % 25)::int as c_nationkey, balance / 2 + 0.25 as c_acctbal from ({near})) to '{tmp_path}/customer.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["album_members", "customer_albums"])
def test_half_balances_as_in_sql(spark, half_balances, name):
    c = duckdb.connect()
    for t in ("orders", "supplier", "customer"):
        c.sql(f"create view {t} as select * from '{half_balances}/{t}.parquet'")
    got = sorted((r.album_id, r.members) for r in Q.QUERIES[name](spark, half_balances).collect())
    assert got == sorted(c.sql(f"select album_id, members from ({Q.ORACLE_SQL[name]})").fetchall())


def test_prompts_are_ranked_by_rounded_scores(spark):
    images = spark.createDataFrame([(1, [1.0, 0.0])], "image_id long, embedding array<double>")
    prompts = spark.createDataFrame([("b", [0.5000002, 0.0]), ("a", [0.5, 0.0])], "name string, embedding array<double>")
    assert [r.name for r in tags.zero_shot(images, prompts).orderBy("rank").collect()] == ["b", "a"]
    assert [r.name for r in tags.zero_shot(images, prompts, digits=6).orderBy("rank").collect()] == ["a", "b"]


def test_cells_of_albums_are_not_broadcast(spark):
    assets = spark.range(300).selectExpr("id", "id % 8 as root_id", "concat('f', id) as filename", "'o' as extension", "id * 10 as size_bytes", "id * 100 as mtime", "cast(null as bigint) as taken_at", "1.0D as gps_lat", "1.0D as gps_lng", "cast(null as bigint) as deleted_at")
    albums = spark.range(50).select("id", F.to_json(F.struct((F.col("id") * 20).alias("sizeMin"), (F.col("id") * 20 + 500).alias("sizeMax"), (F.col("id") * 90).alias("takenFrom"))).alias("filter_json"))
    for found in (boxes.members(assets, albums), boxes.counts(assets, albums)):
        assert not inner_broadcasts(found) and found.count() > 0


def test_lists_with_the_same_tags_are_looked_up_once(spark):
    links = spark.range(100).select(F.col("id").alias("image_id"), F.explode(F.array(F.col("id") % 2, 10 + F.col("id") % 3)).alias("tag_id"))
    lists = spark.range(60).select(F.col("id").alias("list_id"), F.explode(F.array(F.lit(1).cast("long"), F.when(F.col("id") % 2 == 0, 11).otherwise(12).cast("long"))).alias("tag_id"))
    assert tags.list_classes(lists).select("rep").distinct().count() == 2
    got = {r.list_id: r.images for r in tags.counts_of_lists(tags.tag_bitmaps(links), lists).collect()}
    assert got == {i: sum(n % 2 == 1 and n % 3 == (1 if i % 2 == 0 else 2) for n in range(100)) for i in range(60)}


def test_a_small_scan_is_scored_on_all_cores(spark, tmp_path):
    spark.range(200).coalesce(1).write.parquet(f"{tmp_path}/t")

    def score(rows):
        if (rows["id"] == 7).any():
            raise ValueError("bad")
        return rows.assign(result=rows["id"] * 2)[rows["id"] != 9][["id", "result"]]

    found = backlog.run_scorer(spark.read.parquet(f"{tmp_path}/t"), score, "long", 16)
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {r.id: (r.result, r.error) for r in found.collect()}
    assert got == {i: (None, "ValueError: bad") if i == 7 else (None, "no result") if i == 9 else (2 * i, None) for i in range(200)}


def test_links_of_a_few_tags_are_not_dealt_out_by_tag(spark):
    links = spark.range(4_000).select(F.col("id").alias("image_id"), (F.col("id") % 2).alias("tag_id"), F.lit(1.0).alias("score")).repartition(3, "image_id")
    table = spark.range(3_000).select("id", F.concat(F.lit("t"), "id").alias("name")).groupBy("id").agg(F.max("name").alias("name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as small beside the tags as the usual one is beside Spark's estimate
    try:
        named = tags.with_names(links, table)
        assert "BroadcastHashJoin" in named._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in tags.best_per_tag(named).where("image_id = 7").collect()] == [(7, "t1", 1.0, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_tags_are_put_together_after_they_are_dealt_out(spark):
    table, links = views.tags(spark, SF)
    assert "Aggregate" not in links._jdf.queryExecution().optimizedPlan().toString()  # a part's links come from its row
    best = tags.best_per_tag(links.withColumn("name", F.col("tag_id").cast("string")))
    assert re.search(r"HashAggregate[^\n]*\n[^\n]*HashAggregate[^\n]*\n[^\n]*Exchange hashpartitioning\(image_id", best._jdf.queryExecution().executedPlan().toString())


def test_signatures_are_made_once_for_all_groups(spark):
    made = spark.sparkContext.accumulator(0)

    def costly(parts):
        for part in parts:
            made.add(len(part))
            yield part.assign(dhash=part["id"] // 2 * 64)

    rows = spark.range(40).selectExpr("id", "cast(id % 20 as string) as content_hash", "cast(null as bigint) as deleted_at")
    found = fingerprint.find_groups(rows.mapInPandas(costly, "id long, content_hash string, deleted_at long, dhash long"), "both", 0)
    assert found.groupBy("method").count().orderBy("method").collect() == [("exact", 40), ("phash", 40)]
    assert made.value == 40


def test_a_batch_of_a_stream_is_worked_out_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def costly(parts):
        for part in parts:
            made.add(len(part))
            yield part

    table = tables.VersionedTable(spark, f"file://{tmp_path}/catalog")
    table.write(views.orders(spark, SF))
    spark.range(8).select(F.col("id").alias("root_id")).write.parquet(f"{tmp_path}/fired")
    fired = spark.readStream.schema("root_id long").parquet(f"{tmp_path}/fired").mapInPandas(costly, "root_id long")
    listing = views.listing(spark, SF)
    tables.reconcile_into(fired, table, lambda roots: listing.join(roots, "root_id", "left_semi"), lambda: 9, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    assert made.value == 8
    assert table.read().where("deleted_at = 9").count() > 0


def test_signature_as_in_sql():
    text = "one two three four two three four one two three"
    runs = {" ".join(text.split()[i : i + 3]) for i in range(8)}
    values = [int(hashlib.md5(r.encode()).hexdigest()[:16], 16) for r in runs]
    bits = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
    assert views._signature(text) % (1 << 64) == bits
    assert views._signature("") % (1 << 64) == int(hashlib.md5(b"").hexdigest()[:16], 16)


def test_a_plain_scorer_gets_lists_and_fails_like_one_of_frames(spark):
    def frames(rows):
        if (rows["id"] % 7 == 3).any():
            raise ValueError("bad")
        return rows.assign(result=rows["t"].str.len())[rows["id"] != 9][["id", "result"]]

    def lists(rows):
        assert type(rows["id"]) is list and len(rows["id"]) <= 4
        if any(i % 7 == 3 for i in rows["id"]):
            raise ValueError("bad")
        kept = [(i, None if t is None else len(t)) for i, t in zip(rows["id"], rows["t"], strict=True) if i != 9]
        return {"id": [i for i, _ in kept], "result": [n for _, n in kept]}

    chosen = spark.range(100).selectExpr("id", "if(id = 6, null, repeat('x', cast(id % 5 as int))) as t")
    got, wanted = ({tuple(r) for r in backlog.run_scorer(chosen, *how).collect()} for how in ((lists, "long", 4, True), (frames, "long", 4)))
    assert got == wanted and len(got) == 100
    assert backlog.run_scorer(chosen.where("false"), lists, "long", 4, plain=True).count() == 0
