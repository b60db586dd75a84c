"""Small cases of the operators that change state, cluster, read files or stream."""

import hashlib
import random
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetlake import schemas
from assetlake.operators import backlog, browse, faces, fingerprint, graph, numbering, reconcile, resolve, tags, textsearch, vectors
from assetlake.plans import views
from assetlake.sources import export, files
from assetlake.streaming import events


def assets(spark, rows):
    """Assets from dictionaries; what is not given is null."""
    names = schemas.ASSETS.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.ASSETS)


def asset(id_, **more):
    return {"id": id_, "root_id": 1, "rel_path": f"a/{id_}.jpg", "filename": f"{id_}.jpg", "extension": "jpg", "size_bytes": 42, "mtime": 100, "thumb_status": "ready"} | more


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


# --- reconciliation ------------------------------------------------------------------


def test_reconcile_resets_changed_and_restores_deleted(spark):
    prev = assets(spark, [asset(1, content_hash="x", dhash=12345), asset(2), asset(3), asset(4, deleted_at=50)])
    listing = spark.createDataFrame([(1, "a/1.jpg", "1.jpg", "jpg", 42, 200), (1, "a/2.jpg", "2.jpg", "jpg", 42, 100), (1, "a/4.jpg", "4.jpg", "jpg", 42, 100), (1, "b/9.png", "9.png", "png", 7, 7), (1, "a/9.png", "9.png", "png", 7, 7)], "root_id long, rel_path string, filename string, extension string, size_bytes long, mtime long")
    changes = reconcile.classify(prev, listing)
    assert {r.rel_path: r.change for r in changes.collect()} == {"a/1.jpg": "updated", "a/2.jpg": "unchanged", "a/3.jpg": "removed", "a/4.jpg": "restored", "b/9.png": "added", "a/9.png": "added"}
    after = {r.id: r for r in reconcile.apply_changes(prev, changes, 900).collect()}
    assert after[1].content_hash is None and after[1].dhash is None and after[1].mtime == 200 and after[1].thumb_status == "pending"
    assert after[3].deleted_at == 900 and after[4].deleted_at is None and after[2].thumb_status == "ready"
    assert (after[5].rel_path, after[6].rel_path) == ("a/9.png", "b/9.png")
    assert [tuple(r)[1:] for r in reconcile.scan_summary(changes).collect()] == [(2, 2, 1, 5)]


def test_numbers_are_consecutive_whatever_the_sampling(spark):
    """More rows than the sampling of ranges sees, and columns that a plan prunes."""
    rows = spark.range(120_000).selectExpr("id % 7 as root_id", "sha2(cast(id as string), 256) as rel_path", "id as other")
    got = numbering.numbered(rows, ["root_id", "rel_path"], 500).select("id", "root_id", "rel_path").toPandas().sort_values(["root_id", "rel_path"])
    assert got["id"].tolist() == list(range(501, 120_501))
    assert numbering.numbered(rows.where("false"), ["root_id"], 5).count() == 0


def test_two_renames_to_one_name(spark):
    prev = assets(spark, [asset(1), asset(2), asset(3)])
    new = spark.createDataFrame([(1, "c.jpg", 7), (2, "c.jpg", 8), (3, "3.jpg", 9)], "id long, new_name string, size_bytes long")
    renamed, rejects, undo = reconcile.rename_assets(prev, new, 5)
    assert {r.id: (r.rel_path, r.size_bytes, r.indexed_at) for r in renamed.collect()} == {1: ("a/c.jpg", 7, 5), 2: ("a/2.jpg", 42, None), 3: ("a/3.jpg", 9, 5)}
    assert [(r.id, r.reason) for r in rejects.collect()] == [(2, "name is taken")] and undo.count() == 2


def test_incomplete_listing_removes_nothing(spark):
    prev = assets(spark, [asset(1)])
    none = spark.createDataFrame([], "root_id long, rel_path string, filename string, extension string, size_bytes long, mtime long")
    changes = reconcile.classify(prev, none, complete=False)
    assert [r.change for r in changes.collect()] == ["kept"]
    assert reconcile.apply_changes(prev, changes, 1).first().deleted_at is None


def test_backfill_only_fills_nulls(spark):
    prev = assets(spark, [asset(1, width=10), asset(2)])
    meta = spark.createDataFrame([(1, 99, 5)], "id long, width long, height long")
    got = {r.id: (r.width, r.height, r.indexed_at) for r in reconcile.backfill_metadata(prev, meta, 7).collect()}
    assert got == {1: (10, 5, 7), 2: (None, None, None)}


def test_rename(spark):
    prev = assets(spark, [asset(1), asset(2), asset(3)])
    new = spark.createDataFrame([(1, " new.PNG "), (2, "a/b.jpg"), (3, "2.jpg"), (9, "x.jpg")], "id long, new_name string")
    renamed, rejects, undo = reconcile.rename_assets(prev, new, 5)
    row = renamed.where("id = 1").first()
    assert (row.rel_path, row.filename, row.extension) == ("a/new.PNG", "new.PNG", "png")
    assert {r.id: r.reason for r in rejects.collect()} == {2: "invalid name", 3: "name is taken", 9: "unknown asset"}
    assert [r.can_undo_until for r in undo.collect()] == [5 + 30 * 86400]


def test_roots(spark):
    roots = spark.createDataFrame([(1, "/a", None, "local", True, None, 1, None)], schemas.ROOTS)
    more = reconcile.add_roots(roots, spark.createDataFrame([("/a", "x", "local"), ("/b", None, "network")], "path string, label string, type string"), 9)
    assert [(r.id, r.path, r.enabled) for r in reconcile.list_roots(more).collect()] == [(1, "/a", True), (2, "/b", True)]
    assert reconcile.patch_roots(more, spark.createDataFrame([(2, "L")], "id long, label string")).where("id = 2").first().label == "L"
    left = reconcile.remove_roots({"roots": more, "assets": assets(spark, [asset(1)]), "faces": spark.createDataFrame([(1, 1)], "id long, image_id long")}, [1])
    assert [left[k].count() for k in ("roots", "assets", "faces")] == [1, 0, 0]


def test_statuses(spark):
    prev = assets(spark, [asset(1, ocr_status="failed"), asset(2, ocr_status="ready"), asset(3, ocr_status="disabled", thumb_status="failed")])
    assert {r.id: r.ocr_status for r in reconcile.mark_pending(prev, "ocr_status").collect()} == {1: "pending", 2: "ready", 3: "disabled"}
    some = spark.createDataFrame([(2,)], "id long")
    assert {r.id: r.ocr_status for r in reconcile.mark_pending(prev, "ocr_status", some).collect()} == {1: "failed", 2: "pending", 3: "disabled"}
    with pytest.raises(Exception, match="cannot be"):
        reconcile.set_status(prev, spark.createDataFrame([(1, "odd")], "id long, status string"), "ocr_status").collect()


# --- duplicates ----------------------------------------------------------------------


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_duplicates_of_flipped_bits(spark):
    rng, rows, n = random.Random(12), [], 0
    bases: list[int] = []
    while len(bases) < 30:
        h = rng.getrandbits(64)
        if all((h ^ b).bit_count() >= 10 for b in bases):
            bases.append(h)
    for g, h in enumerate(bases):
        for k in range(rng.randint(2, 4)):
            x = h
            for _ in range(rng.randint(0, 2) if k else 0):
                x ^= 1 << rng.randrange(64)
            rows.append((n, x - (1 << 64) if x >> 63 else x, g))
            n += 1
    df = spark.createDataFrame(rows, "id long, dhash long, grp long")
    found = fingerprint.neardup_groups(df.select("id", "dhash"), 2).select("id", F.col("group_id").alias("grp"))
    assert fingerprint.pairwise_quality(df.select("id", "grp"), found).first().f1 >= 0.92


@pytest.mark.parametrize("t", [0, 1, 2, 5, 7])
def test_hamming_pairs_against_all_pairs(spark, t):
    rng = random.Random(t)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for h in hashes]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, dhash long")
    reps = {}
    for i, h in enumerate(hashes):
        reps.setdefault(h, i)
    wanted = {(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and (x ^ y).bit_count() <= t}
    assert {(r.a, r.b) for r in fingerprint.hamming_pairs(df, t).collect()} == wanted


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], "id long, grp long")
    assert tuple(fingerprint.pairwise_quality(none, none).first()) == (0, 0, 0, 1.0, 1.0, 1.0)


def groups_table(spark, rows):
    return spark.createDataFrame([(i, m, None, None, s, 1, None) for i, m, s in rows], schemas.GROUPS)


def test_batch_plan_and_apply(spark):
    table = assets(spark, [asset(1, size_bytes=10, width=100, height=100), asset(2, size_bytes=20, width=1000, height=1000), asset(3, size_bytes=30, width=200, height=200), asset(4), asset(5, deleted_at=1)])
    items = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (2, 5, 1.0)], schemas.GROUP_ITEMS)
    groups = groups_table(spark, [(1, "exact", "open"), (2, "exact", "open")])
    plan, failures = resolve.plan_batch(groups, items, table, "exact", "largest")
    assert [tuple(r) for r in plan.collect()] == [(1, "trash", 2, [1, 3])]
    assert ids(failures, "group_id") == [2]
    with pytest.raises(ValueError, match="one method"):
        resolve.plan_batch(groups, items, table, "all", "largest")
    ok = spark.createDataFrame([(1, True), (3, True)], "id long, ok boolean")
    done, _, failed = resolve.apply_plan(plan, ok, groups, items, 200)
    assert {r.id: (r.status, r.keep_image_id, r.resolved_at) for r in done.collect()} == {1: ("resolved", 2, 200), 2: ("open", None, None)}
    assert failed.count() == 0
    partly = spark.createDataFrame([(1, True), (3, False)], "id long, ok boolean")
    done, left, failed = resolve.apply_plan(plan, partly, groups, items, 200)
    assert done.where("id = 1").first().status == "open" and ids(left.where("group_id = 1"), "image_id") == [2, 3] and failed.first().failed == 1


def test_delete_and_undo(spark):
    table = assets(spark, [asset(1), asset(2), asset(3)])
    roots = spark.createDataFrame([(1, "/r")], "id long, path string")
    after, undo, failures = resolve.soft_delete(table, roots, spark.createDataFrame([(1,), (2,), (9,)], "id long"), 100)
    assert ids(after.where("deleted_at is null")) == [3] and ids(failures) == [9]
    log = undo.withColumn("id", F.lit(1).cast("long"))
    assert resolve.undo_history(log).first().item_count == 2
    back, log = resolve.undo(after, log, 1, 200)
    assert back.where("deleted_at is null").count() == 3
    with pytest.raises(ValueError, match="already"):
        resolve.undo(back, graph.written(log), 1, 300)
    legacy = spark.createDataFrame([(7, "trash", '{"items":[{"imageId":1,"originalPath":"/x"},{"imageId":2,"originalPath":"/y","permanent":true}]}', 5, None, 1)], "id long, action string, payload_json string, can_undo_until long, undone_at long, created_at long")
    assert ids(resolve.undo(after, legacy, 7, 9)[0].where("deleted_at is null")) == [1, 3]
    with pytest.raises(ValueError, match="late"):
        resolve.undo(after, legacy, 7, 9, enforce_window=True)
    assert resolve.expired_undo(legacy, 9).count() == 1


def test_merge_and_rebuild_groups(spark):
    items = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (2, 2, 0.5), (2, 3, 1.0)], schemas.GROUP_ITEMS)
    groups = groups_table(spark, [(1, "phash", "open"), (2, "phash", "dismissed")])
    left, merged = resolve.merge_groups(groups, items, 2, 1)
    assert ids(left) == [1] and sorted(map(tuple, merged.collect())) == [(1, 1, 1.0), (1, 2, 0.9), (1, 3, 1.0)]
    new = spark.createDataFrame([(5, 2, 1.0), (5, 3, 1.0), (8, 7, 1.0), (8, 9, 1.0)], "group_id long, id long, similarity double")
    table, rows = fingerprint.rebuild_groups(groups, items, new, "phash", 2.0, 50)
    assert ids(table) == [2, 3, 4] and rows.count() == 6
    table, _ = fingerprint.rebuild_groups(groups, items, new, "phash", 2.0, 50, suppress_dismissed=True)
    assert ids(table) == [2, 3]


# --- search, tags, faces ----------------------------------------------------------------


def test_phrase_search(spark):
    table = assets(spark, [asset(1, filename="error.png", ocr_text="Fatal Error 报错"), asset(2, ocr_text="error fatal"), asset(3, ocr_text="FATAL  error", deleted_at=1), asset(4, ocr_text="Çà et là")])
    q = spark.createDataFrame([(1, '"fatal'), (2, "fatal-error"), (3, "  "), (4, "ca"), (5, "报错 error")], "query_id long, query string")
    got = sorted((r.query_id, r.id) for r in textsearch.search(table, q).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (4, 4), (5, 1)]


def test_search_tokens(spark):
    q = spark.createDataFrame([(1, "#a #a size:>5MB size:<=1GB cat"), (2, "size:abc format:.PNG"), (3, "   "), (4, None)], "query_id long, query string")
    got = {r.query_id: (r.text, r.tags, r.format, r.size_min, r.size_max) for r in vectors.parse_search(q).collect()}
    assert got[1] == ("cat", ["a"], None, 5 << 20, 1 << 30) and got[2] == ("", [], "png", None, None)
    assert got[3] == got[4] == ("", [], None, None, None)


def test_vectors(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "image_id long, embedding array<float>")
    new = spark.createDataFrame([(2, [1.0, 1.0]), (3, [0.5, 0.5])], "image_id long, embedding array<float>")
    assert vectors.upsert_vectors(old, new, 2).count() == 3
    with pytest.raises(Exception, match="2 elements"):
        vectors.upsert_vectors(old, spark.createDataFrame([(9, [1.0])], "image_id long, embedding array<float>"), 2).collect()
    near = vectors.top_k(old, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>"), 1).first()
    assert (near.image_id, near.distance, near.score) == (1, 0.0, 1.0)
    with pytest.raises(Exception, match="another number"):
        vectors.top_k(old, spark.createDataFrame([(0, [1.0])], "query_id long, query array<double>"), 1).collect()
    assert vectors.similar_to(old, spark.createDataFrame([(9,)], "image_id long")).count() == 0


def test_hybrid_falls_back_to_names(spark):
    table = assets(spark, [asset(1, filename="cat.jpg"), asset(2, filename="dog.jpg")])
    none = spark.createDataFrame([], "image_id long, embedding array<float>")
    tag_table = spark.createDataFrame([(5, "x")], "id long, name string")
    links = spark.createDataFrame([(2, 5, "ai", 1.0)], "image_id long, tag_id long, source string, score double")
    found = vectors.hybrid_search(table, links, tag_table, none, "CAT", [1.0])
    assert [tuple(r) for r in found.collect()] == [(1, 0.5, "filename", 1)]
    assert [tuple(r) for r in vectors.hybrid_search(table, links, tag_table, none, "#x", None).collect()] == [(2, 1.0, "dsl", 1)]


def test_faces(spark):
    f = spark.createDataFrame([(1, 10, 7, None, 0.9), (2, 11, 7, None, 0.8), (3, 12, None, None, 0.7)], schemas.FACES)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (9, [1.0, 0.0])], "face_id long, embedding array<float>")
    out, clusters = faces.cluster_faces(f, v, prior=spark.createDataFrame([(7, "Ann")], "id long, label string"))
    assert {r.id: r.cluster_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    assert {(r.id, r.label, r.sample_image_id, r.face_count) for r in clusters.collect()} == {(1, "Ann", 10, 2), (3, None, 12, 1)}
    moved, left = faces.merge_clusters(out, clusters, 3, 1)
    assert [(r.id, r.face_count, r.sample_image_id) for r in left.collect()] == [(1, 3, 10)] and moved.where("cluster_id = 3").count() == 0
    new = spark.createDataFrame([(10, "not json", 1.7), (10, '{"x":1,"y":2,"w":3,"h":4}', 0.5)], "image_id long, bbox_json string, confidence double")
    rows = {r.id: (tuple(r.bbox), r.confidence) for r in faces.replace_faces(f, new).where("image_id = 10").collect()}
    assert rows == {4: ((0, 0, 0, 0), 1.0), 5: ((1, 2, 3, 4), 0.5)}


def test_clear_ai_tags(spark):
    links = spark.createDataFrame([(1, 1, "ai", 0.9, 0), (1, 2, "user", 1.0, 0)], schemas.TAG_LINKS)
    table = spark.createDataFrame([(1, "sea", "ai", None, 0), (2, "sun", "user", None, 0), (3, "idle", "user", None, 0)], schemas.TAGS)
    kept, used, after = tags.clear_ai_tags(links, table, assets(spark, [asset(1, tag_status="ready")]))
    assert kept.count() == 1 and ids(used) == [2] and after.first().tag_status == "pending"


def test_albums(spark):
    none = spark.createDataFrame([], schemas.ALBUMS)
    new = spark.createDataFrame([(" png ", '{"formats":["png"],"limit":200}', None, None), (" ", "{}", None, 1), ("bad", "{", None, 1)], "name string, filter_json string, icon string, sort_order long")
    albums, rejects = browse.save_albums(none, new, 3)
    assert [r.name for r in albums.collect()] == ["png"] and rejects.count() == 2
    table = assets(spark, [asset(1, extension="png"), asset(2), asset(3, extension="png", deleted_at=1)])
    assert [(r.album_id, r.id) for r in browse.album_members(table, albums).collect()] == [(1, 1)]


# --- enrichment, files, streams ------------------------------------------------------------


def test_one_bad_row_fails_alone(spark):
    chosen = spark.range(5).toDF("id")

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["id"] == 3).any():
            raise ValueError("no")
        return pd.DataFrame({"id": rows["id"], "result": rows["id"].map(str)})

    results = backlog.run_scorer(chosen, fn, "string", 2)
    assert {r.id: (r.result, r.error) for r in results.collect()} == {0: ("0", None), 1: ("1", None), 2: ("2", None), 3: (None, "ValueError: no"), 4: ("4", None)}
    table = assets(spark, [asset(i, ocr_status="pending") for i in (2, 3, 9)])
    after = {r.id: (r.ocr_status, r.ocr_text) for r in backlog.merge_results(table, results, "ocr", "ocr_text").collect()}
    assert after == {2: ("ready", "2"), 3: ("failed", None), 9: ("pending", None)}


def test_fallback_vectors_are_unit_and_stable(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "image_id long, key string")
    v = {r.image_id: r.embedding for r in backlog.fallback_vectors(keys).collect()}
    assert v[1] == v[2] != v[3] and len(v[1]) == 512 and abs(sum(x * x for x in v[1]) - 1) < 1e-5


def test_ocr_lines(spark):
    df = spark.sql("select array(array('box', ' a ', '1'), array('box', ' '), array('box', ' ', '1'), array('box', 'b', '1')) as l")
    assert df.select(backlog.ocr_text(F.col("l"))).first()[0] == "a\nb"


def png(path, pixels):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    rising = [[(x * 10,) * 3 for x in range(18)] for _ in range(16)]
    png(tmp_path / "sub dir" / "A+1.PNG", rising)
    png(tmp_path / "flat.png", [[(7, 7, 7)] * 4] * 3)
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n")
    listed = files.scan_assets(spark, 5, str(tmp_path))
    assert {(r.rel_path, r.filename, r.extension) for r in listed.collect()} == {("sub dir/A+1.PNG", "A+1.PNG", "png"), ("flat.png", "flat.png", "png"), ("broken.png", "broken.png", "png")}
    images = files.read_images(spark, [r.path for r in listed.collect()])
    sides = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in images.collect()}
    assert (18, 16) in sides.values() and (4, 3) in sides.values() and (None, None) in sides.values()
    hashes = {r.path.rsplit("/", 1)[1][0]: r.dhash for r in files.image_hashes(images).collect()}
    assert hashes["A"] == -1 and hashes["f"] == 0 and hashes["b"] is None


def test_report_and_snapshot(spark, tmp_path):
    table = assets(spark, [asset(1, filename='x,"y".jpg', dhash=-1), asset(2)])
    items = spark.createDataFrame([(1, 1, 1.0), (1, 2, None)], schemas.GROUP_ITEMS)
    roots = spark.createDataFrame([(1, "/r")], "id long, path string")
    report = export.duplicates_report(groups_table(spark, [(1, "exact", "open")]), items, table, roots)
    assert len(report.columns) == 14
    export.export_duplicates_csv(report.coalesce(1), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfgroup_id,") and b'"x,""y"".jpg"' in raw and str(2**64 - 1).encode() in raw and b"1.0000" in raw
    export.export_snapshot({"items": items, "roots": roots}, str(tmp_path / "snap"))
    back = export.restore_snapshot(spark, str(tmp_path / "snap"), str(tmp_path / "staging"))
    assert back["items"].count() == 2 and back["roots"].count() == 1
    (tmp_path / "thumbs" / "ab").mkdir(parents=True)
    (tmp_path / "thumbs" / "ab" / "x 1%.webp").write_bytes(b"picture")
    manifest = export.export_snapshot({"items": items}, str(tmp_path / "snap2"), {"thumbnails": f"file://{tmp_path}/thumbs"})
    assert {(r.table, r.kind, r.rows) for r in manifest.collect()} == {("items", "table", 2), ("thumbnails", "folder", 1)}
    (kept,) = export.restore_snapshot(spark, str(tmp_path / "snap2"), str(tmp_path / "staging2"))["thumbnails"].collect()
    assert (kept.rel_path, kept.bytes, kept.sha256, bytes(kept.content)) == ("ab/x 1%.webp", 7, hashlib.sha256(b"picture").hexdigest(), b"picture")
    spark.createDataFrame([(1, 1, 0.5), (1, 2, None)], schemas.GROUP_ITEMS).write.mode("overwrite").parquet(str(tmp_path / "snap" / "items"))
    with pytest.raises(ValueError, match="items"):
        export.restore_snapshot(spark, str(tmp_path / "snap"), str(tmp_path / "staging3"))


def test_event_routing(spark):
    roots = spark.createDataFrame([(1, "/a", True, "local", 2), (2, "/a/b", True, "local", 1), (3, "/n", True, "network", 1), (4, "/c/", False, "local", 1)], "id long, path string, enabled boolean, type string, created_at long")
    found = events.route_events(spark.createDataFrame([("/a/b/x",), ("/a/bc",), ("/n/x",), ("/c/x",), ("/a",)], "path string"), roots)
    assert {(r.path, r.root_id) for r in found.collect()} == {("/a/b/x", 2), ("/a/bc", 1), ("/a", 1)}
    assert ids(events.skipped_roots(roots)) == [3]


def test_debounce_across_pieces_of_time(spark):
    rng = random.Random(3)
    times = {}
    for root in (1, 2):
        at, own = 1_700_000_000_000_000, []
        for _ in range(3000):
            at += rng.choice([100_000, 400_000, 999_999, 1_000_000, 90_000_000, 400_000_000])
            own.append(at)
        times[root] = own
    df = spark.createDataFrame([(r, t) for r, own in times.items() for t in own], "root_id long, at long").select("root_id", F.timestamp_micros("at").alias("ts"))
    wanted = []
    for root, own in times.items():
        last = None
        for t in own:
            if last is None or t - last >= 1_000_000:
                last = t
                wanted.append((root, t))
    assert sorted(tuple(r) for r in events.debounce_batch(df).select("root_id", F.unix_micros("ts")).collect()) == wanted


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(r, t) for r in (1, 2) for t in (0.0, 0.9, 1.0, 1.9, 2.0)]
    df = spark.createDataFrame(rows, "root_id long, t double").select("root_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    batch = sorted((r.root_id, r.ts.timestamp()) for r in events.debounce_batch(df).collect())
    assert batch == [(r, t) for r in (1, 2) for t in (0.0, 1.0, 2.0)]
    for n, part in enumerate(("t < 1", "t >= 1")):
        spark.createDataFrame(rows, "root_id long, t double").where(part).select("root_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema("root_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = events.debounce(stream).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.root_id, r.ts.timestamp()) for r in spark.table("fired").collect()) == batch


def test_signature_of_a_very_long_document(spark, tmp_path):
    letters = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    w = [letters(n) for n in range(140_000)]
    spark.createDataFrame([(1, " ".join(w), 5 * len(w))], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    votes = [0] * 64
    for n in range(len(w) - 2):
        v = int(hashlib.md5(" ".join(w[n : n + 3]).encode()).hexdigest()[:16], 16)
        for b in range(64):
            votes[b] += 1 if v >> b & 1 else -1
    wanted = sum(1 << b for b in range(64) if votes[b] > 0)
    (got,) = views.signatures(spark, str(tmp_path)).collect()
    assert got.dhash & (1 << 64) - 1 == wanted


def test_extended_groups_equal_a_rebuild(spark):
    """Signatures that come in three parts, with links inside a part, between parts and to equal ones."""
    rng = random.Random(21)
    base = [rng.getrandbits(63) for _ in range(30)]
    rows = []
    for n in range(240):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            h ^= 1 << rng.randrange(63)
        rows.append((rng.randrange(10_000) * 1000 + n, h if n % 17 else None))
    rng.shuffle(rows)
    schema = "id long, dhash long"
    members, keys = fingerprint.grouped_hashes(spark.createDataFrame(rows[:150], schema), 3)
    for part in (rows[150:200], rows[200:200], rows[200:]):
        members, keys = (graph.written(df) for df in fingerprint.extend_groups(members, keys, spark.createDataFrame(part, schema), 3))
    wanted, wanted_keys = fingerprint.grouped_hashes(spark.createDataFrame(rows, schema), 3)
    assert {tuple(r) for r in members.collect()} == {tuple(r) for r in wanted.collect()} and members.count() == wanted.count()
    assert {(r.key, r.dhash) for r in keys.collect()} == {(r.key, r.dhash) for r in wanted_keys.collect()} and keys.count() == wanted_keys.count()


def test_bitmaps_of_tags(spark):
    rng = random.Random(22)
    images = [1, 2, 32_768, 32_769, 70_000, 0, -3, *(rng.randrange(200_000) for _ in range(60))]
    links = {(i, t) for i in images for t in range(6) if rng.random() < 0.6}
    lists = [(n, t) for n in range(12) for t in rng.sample(range(7), rng.randint(1, 3))] + [(0, 0), (0, 0)]
    bitmaps = tags.tag_bitmaps(spark.createDataFrame(sorted(links), "image_id long, tag_id long"))
    found = tags.lists_of_tags(bitmaps, spark.createDataFrame(lists, "list_id long, tag_id long"))
    wanted = {(n, i) for n, _ in lists for i in images if all((i, t) in links for m, t in lists if m == n)}
    assert {tuple(r) for r in tags.images_in(found).collect()} == wanted
    assert {r.list_id: r.images for r in tags.image_counts(found).collect()} == {n: len({i for m, i in wanted if m == n}) for n, _ in wanted}


def test_kept_timeline_loses_an_extreme(spark):
    from assetlake.operators import rollup

    schema = "id long, taken_at long, mtime long, deleted_at long"
    rows = spark.createDataFrame([(1, 100, 0, None), (2, 200, 0, None), (3, 40 * 86_400, 0, None), (4, 300, 0, None)], schema)
    gone = spark.createDataFrame([(4, 300, 0, 9), (1, 150, 0, None)], schema)
    months, moments = rollup.updated_timeline(*rollup.kept_timeline(rows), rows.where("id in (1, 4)"), gone)
    assert [tuple(r) for r in rollup.newest_months(months).collect()] == [(1970, 2, 1, 3_456_000, 3_456_000), (1970, 1, 2, 150, 200)]
    months, moments = rollup.updated_timeline(months, moments, rows.where("id = 3"), rows.where("false"))
    assert [tuple(r) for r in months.collect()] == [(1970, 1, 2, 150, 200)] and moments.count() == 2


def test_debounce_of_dense_roots_in_many_tasks(spark, monkeypatch):
    """Roots without a gap, longer than one task takes, against the loop; also a root without an id."""
    monkeypatch.setattr(events, "_SHORT", 2)
    monkeypatch.setattr(events, "_PIECE", 4)
    rng = random.Random(23)
    rows = []
    for root, gap, n in ((1, 900_000, 600), (2, 300_000, 900), (3, 5_000_000, 50), (None, 700_000, 300), (4, 1_000_000, 200)):
        t = 1_700_000_000_000_000 + rng.randrange(10**6)
        for _ in range(n):
            t += gap if root == 4 else rng.randrange(gap)
            rows += [(root, t)] * rng.choice((1, 1, 2))
    df = spark.createDataFrame(rows, "root_id long, at long").select("root_id", F.timestamp_micros("at").alias("ts"))
    wanted, last = [], {}
    for root, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if root not in last or t - last[root] >= 1_000_000:
            last[root] = t
            wanted.append((root, t))
    got = [tuple(r) for r in events.debounce_batch(df, 1.0).select("root_id", F.unix_micros("ts")).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_undo_entry_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(resolve, "ITEMS_OF_A_ROW", 2)
    table = assets(spark, [asset(n) for n in range(1, 10)])
    after, undo, _ = resolve.soft_delete(table, spark.createDataFrame([(1, "/r")], "id long, path string"), spark.createDataFrame([(n,) for n in range(1, 8)], "id long"), 100)
    log = graph.written(undo.withColumn("id", F.lit(1).cast("long")))
    assert log.count() > 1 and resolve.undo_history(log).first().item_count == 7 and resolve.undo_history(log).count() == 1
    back, log = resolve.undo(after, log, 1, 200)
    assert back.where("deleted_at is null").count() == 9 and log.where("undone_at is null").count() == 0
    assert resolve.expired_undo(undo.withColumn("id", F.lit(2).cast("long")), 10**12).count() == 1
