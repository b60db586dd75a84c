"""Registered queries of the operators that look up, change and undo the catalog's state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as E
from ..operators import backlog, browse, faces, fingerprint, graph, reconcile, resolve, rollup, tags, vectors
from ..sources import export, files
from ..streaming import events, tables
from . import views as V
from .queries import _EXACT, _GROUPS, _REACH
from .registry import NOW, query

# --- lookups and pages ---------------------------------------------------------------

_FROM, _TO = 757_382_400, 820_454_399
_BY_ROOT = browse.BrowseParams(root_ids=(1, 3, 5), taken_from=_FROM, taken_to=_TO, has_gps=False, sort="filename", direction="asc", limit=500)
_BY_SIZE = browse.BrowseParams(include_deleted=True, sort="size_bytes", direction="asc", offset=10, limit=300)
_ROOT_ROWS = f"select id, filename, extension from assets_ord where deleted_at is null and root_id in (1, 3, 5) and coalesce(taken_at, mtime) between {_FROM} and {_TO} and gps_lat is null order by lower(filename), id limit 500"
_SIZE_ROWS = "select id, filename, extension from assets_ord order by size_bytes, id limit 300 offset 10"


@query(f"with {V.ORDERS} {_ROOT_ROWS}")
def browse_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.browse(V.orders(spark, sf_dir), _BY_ROOT).select("id", "filename", "extension")


@query(f"with {V.ORDERS} {_SIZE_ROWS}")
def browse_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.browse(V.orders(spark, sf_dir), _BY_SIZE).select("id", "filename", "extension")


@query(f"with {V.ORDERS} select * from ({_ROOT_ROWS}) union (select * from ({_SIZE_ROWS}))")
def union_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.union_pages(browse_by_root(spark, sf_dir), browse_by_size(spark, sf_dir))


@query(f"with {V.DOCUMENTS} select id, filename, deleted_at from assets_doc where id = 13")
def asset_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.by_id(V.documents(spark, sf_dir), 13).select("id", "filename", "deleted_at")


@query("select o_custkey as customer, array_to_string(list_sort(list_distinct(list_filter(list(case when o_orderkey % 4 = 0 then -o_orderkey else o_orderkey // 2 end), lambda x: x > 0))), ',') as ids from orders group by o_custkey")
def clean_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.collect_list(F.expr("case when o_orderkey % 4 = 0 then -o_orderkey else o_orderkey div 2 end"))
    lists = V.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(ids.alias("ids"))
    return lists.select("customer", F.array_join(browse.clean_ids(F.col("ids")).cast("array<string>"), ",").alias("ids"))


@query("select distinct strftime(o_orderdate, '%Y-%m-%d') as day, epoch(o_orderdate)::bigint - 7200 as first_second, epoch(o_orderdate)::bigint - 7200 + 86399 as last_second from orders")
def day_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = V.read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    first, last = E.day_bounds(F.col("day"), "+02:00")
    return days.select(F.col("day").cast("string").alias("day"), first.alias("first_second"), last.alias("last_second"))


@query("select l_orderkey as order_id, l_linenumber as line, case when round(l_quantity * 0.3::double * 1048576)::bigint > 0 then round(l_quantity * 0.3::double * 1048576)::bigint end as bytes from lineitem")
def sizes_in_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), E.megabytes(F.col("l_quantity") * 0.3).alias("bytes"))


@query(f"with {V.SIGNATURES} select id, case when dhash < 0 then dhash::hugeint + 18446744073709551616 else dhash::hugeint end::varchar as unsigned_hash from sig")
def unsigned_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.signatures(spark, sf_dir).select("id", E.unsigned(F.col("dhash")).alias("unsigned_hash"))


# --- albums ----------------------------------------------------------------------------


def _albums(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(albums, rejected): one album for each supplier, some of them without a name or a filter that can be read."""
    filter_json = "case when s_suppkey % 9 = 4 then '{broken' else concat('{\"rootIds\":[', s_nationkey % 8, '],\"sizeMax\":', cast(s_acctbal as bigint) * 20, '}') end"
    new = V.read(spark, sf_dir, "supplier").selectExpr("case when s_suppkey % 10 = 3 then '  ' else concat(' ', s_name) end as name", f"{filter_json} as filter_json", "cast(null as string) as icon", "s_suppkey % 5 as sort_order", "s_suppkey")
    old = spark.createDataFrame([], schemas.ALBUMS)
    return browse.save_albums(old, new, NOW)


_ALBUMS = """valid as (select s_name as name, s_suppkey % 5 as sort_order, s_nationkey % 8 as root_id, case when s_acctbal < 0 then trunc(s_acctbal)::bigint else floor(s_acctbal)::bigint end * 20 as size_max, s_suppkey from supplier where s_suppkey % 10 != 3 and s_suppkey % 9 != 4),
albums as (select *, row_number() over (order by name) as id from valid)"""


@query(f"with {_ALBUMS} select id, name, sort_order from albums where id % 7 != 0")
def listed_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved, _ = _albums(spark, sf_dir)
    kept = browse.drop_albums(saved, saved.where("id % 7 = 0").select("id"))
    return browse.list_albums(kept).select("id", "name", "sort_order")


@query("select s_suppkey, case when s_suppkey % 10 = 3 then 'blank name' else 'invalid filter' end as reason from supplier where s_suppkey % 10 = 3 or s_suppkey % 9 = 4")
def rejected_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _albums(spark, sf_dir)[1].select("s_suppkey", "reason")


@query(f"with {V.ORDERS}, {_ALBUMS} select a.id, filename from assets_ord a join albums b on b.id = 2 and a.root_id = b.root_id where deleted_at is null and size_bytes <= greatest(size_max, 0) order by mtime desc, a.id desc limit 50 offset 5")
def album_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.album_page(V.orders(spark, sf_dir), _albums(spark, sf_dir)[0], 2, offset=5, limit=50).select("id", "filename")


# --- changes of assets -------------------------------------------------------------------


@query(f"""with {V.ORDERS}, meta as (select l_orderkey as id, min(epoch(l_shipdate)::bigint) as taken_at, min(l_returnflag) as camera_make, max(l_quantity)::bigint as width from lineitem group by l_orderkey)
select a.id, coalesce(a.taken_at, m.taken_at) as taken_at, m.camera_make, coalesce(a.width, m.width) as width, case when m.id is not null then {NOW} else epoch(o_orderdate)::bigint + 90000 end as indexed_at from assets_ord a join orders on a.id = o_orderkey left join meta m on a.id = m.id""")
def backfilled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = V.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.unix_timestamp("l_shipdate")).alias("taken_at"), F.min("l_returnflag").alias("camera_make"), F.max("l_quantity").cast("long").alias("width"))
    return reconcile.backfill_metadata(V.orders(spark, sf_dir), meta, NOW).select("id", "taken_at", "camera_make", "width", "indexed_at")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of a scan."""
    status = "case o_orderkey % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'failed' else 'done' end as status"
    started = "case when o_orderkey % 11 = 0 then null else unix_timestamp(o_orderdate) end as started_at"
    return V.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", status, started, "cast(case when o_orderkey % 5 > 1 then unix_timestamp(o_orderdate) + 60 end as bigint) as finished_at")


@query("select o_orderkey as id, case when o_orderkey % 11 = 0 then null else epoch(o_orderdate)::bigint end as started_at from orders order by coalesce(case when o_orderkey % 11 = 0 then null else epoch(o_orderdate)::bigint end, 0) desc, o_orderkey desc limit 20")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.latest_runs(_runs(spark, sf_dir)).select("id", "started_at")


@query(f"select o_orderkey as id, case when o_orderkey % 5 < 3 then 'failed' else 'done' end as status, case when o_orderkey % 5 < 2 then {NOW} else epoch(o_orderdate)::bigint + 60 end as finished_at from orders")
def interrupted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.fail_interrupted(_runs(spark, sf_dir), NOW).select("id", "status", "finished_at")


def _renamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    name = "case id % 100 when 11 then 'a/b.jpg' when 21 then '  ' when 31 then '..' when 41 then concat(' IMG_', id - 1, '.', 'O') else concat('photo_', id % 7, '.JPG') end"
    return reconcile.rename_assets(V.orders(spark, sf_dir), V.orders(spark, sf_dir).where("id % 10 = 1").selectExpr("id", f"{name} as new_name"), NOW)


_RENAMES = """asked as (select id, deleted_at, root_id, split_part(rel_path, '/', 1) || '/' as folder, case id % 100 when 11 then 'a/b.jpg' when 21 then '' when 31 then '..' when 41 then 'IMG_' || (id - 1) || '.O' else 'photo_' || (id % 7) || '.JPG' end as new_name from assets_ord where id % 10 = 1),
judged as (select q.*, case when new_name = '' then 'empty name' when new_name in ('..', 'a/b.jpg') then 'invalid name' when q.deleted_at is not null then 'unknown asset' when exists (select 1 from assets_ord h where h.deleted_at is null and h.root_id = q.root_id and h.rel_path = q.folder || q.new_name and h.id != q.id) then 'name is taken' end as first_reason from asked q),
named as (select *, case when first_reason is null and row_number() over (partition by root_id, folder, new_name, first_reason order by id) > 1 then 'name is taken' else first_reason end as reason from judged)"""


@query(f"with {V.ORDERS}, {_RENAMES} select a.id, coalesce(n.folder || n.new_name, a.rel_path) as rel_path, coalesce(n.new_name, a.filename) as filename, case when n.id is null then a.extension else lower(split_part(n.new_name, '.', 2)) end as extension from assets_ord a left join named n on a.id = n.id and n.reason is null")
def renamed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir)[0].select("id", "rel_path", "filename", "extension")


@query(f"with {V.ORDERS}, {_RENAMES} select id, new_name, reason from named where reason is not null")
def rejected_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir)[1].select("id", "new_name", "reason")


@query(f"with {V.ORDERS}, {_RENAMES} select id, folder || new_name as moved_to from named where reason is null")
def rename_undo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir)[2].select(F.get_json_object("payload_json", "$.imageId").cast("long").alias("id"), F.get_json_object("payload_json", "$.to").alias("moved_to"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as roots with all their columns."""
    named = V.read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id", "concat('/', lower(n_name)) as path", "n_name as label", "'local' as type", "n_nationkey % 2 = 0 as enabled", "cast(n_regionkey as bigint) as created_at")
    return named.select(*(F.col(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ROOTS))


@query("""with roots as (select n_nationkey::bigint as id, '/' || lower(n_name) as path, n_name as label, n_nationkey % 2 = 0 as enabled, n_regionkey::bigint as created_at from nation),
added as (select (select max(id) from roots) + row_number() over (order by path) as id, path, null as label, true as enabled, 9 as created_at from (select '/supplier/' || s_suppkey as path from supplier)),
all_roots as (select * from roots union all select * from added)
select id, path, coalesce(case when id % 3 = 0 then 'patched ' || id end, label) as label, enabled from all_roots""")
def roots_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _roots(spark, sf_dir)
    new = V.read(spark, sf_dir, "supplier").selectExpr("concat('/supplier/', s_suppkey) as path").unionByName(old.select("path"))
    both = reconcile.add_roots(old, new, 9)
    patched = reconcile.patch_roots(both, both.where("id % 3 = 0").selectExpr("id", "concat('patched ', id) as label", "cast(null as boolean) as enabled"))
    return reconcile.list_roots(patched).select("id", "path", "label", "enabled")


@query(f"with {V.ORDERS} select 'assets' as kept, id from assets_ord where root_id not in (1, 2) union all select 'links', l_orderkey from lineitem join assets_ord on id = l_orderkey where root_id not in (1, 2) union all select 'roots', n_nationkey from nation where n_nationkey not in (1, 2)")
def without_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = V.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    left = reconcile.remove_roots({"roots": _roots(spark, sf_dir), "assets": V.orders(spark, sf_dir), "links": links}, [1, 2])
    ids = {"assets": "id", "links": "image_id", "roots": "id"}
    return reduce(DataFrame.unionByName, (left[n].select(F.lit(n).alias("kept"), F.col(c).alias("id")) for n, c in ids.items()))


@query(f"with {V.ORDERS}, u as (select l_orderkey as id, max(case when l_linenumber = 2 then null when l_quantity > 25 then 'ready' else 'failed' end) as status from lineitem group by l_orderkey) select a.id, coalesce(u.status, tag_status) as tag_status from assets_ord a left join u on a.id = u.id")
def updated_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = V.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", "case when l_linenumber = 2 then null when l_quantity > 25 then 'ready' else 'failed' end as status")
    return reconcile.set_status(V.orders(spark, sf_dir), updates, "tag_status").select("id", "tag_status")


_FIRED = f"""with {V.ORDERS}, {V.LISTING}, fired as (select distinct user_id % 10 as root_id from events where event_type in ('click', 'view', 'purchase'))
select a.id, a.root_id, a.rel_path, case when c.change in ('updated', 'restored') then 'pending' else a.thumb_status end as thumb_status, case when c.change = 'removed' then {NOW} when c.change in ('updated', 'restored') then null else a.deleted_at end as deleted_at
from assets_ord a left join classified c on a.id = c.id and c.root_id in (select root_id from fired)
union all
select (select max(id) from assets_ord) + row_number() over (order by root_id, rel_path), root_id, rel_path, 'pending', null from classified where change = 'added' and root_id in (select root_id from fired)"""


@query(_FIRED)
def reconcile_fired_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = events.debounce_batch(events.watched(V.file_events(spark, sf_dir)))
    after = reconcile.reconcile_roots(V.orders(spark, sf_dir), V.listing(spark, sf_dir), fired, NOW)
    return after.select("id", "root_id", "rel_path", "thumb_status", "deleted_at")


@query(_FIRED)
def streamed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream of events whose batches write versions of the catalog."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    table = tables.VersionedTable(spark, graph.fresh_path(spark, "catalog-versions"))
    table.write(V.orders(spark, sf_dir))
    listing = V.listing(spark, sf_dir)
    source = spark.readStream.schema(V.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, as the table may be one file
    fired = events.debounce(events.watched(V.as_file_events(source)))
    query = tables.reconcile_into(fired, table, lambda roots: listing.join(roots, "root_id", "left_semi"), lambda: NOW, graph.fresh_path(spark, "checkpoint"), availableNow=True)
    query.awaitTermination()
    return table.read().select("id", "root_id", "rel_path", "thumb_status", "deleted_at")


# --- backlogs ----------------------------------------------------------------------------


@query(f"""with {V.ORDERS}, steps as (select id, unnest([{{'step': 'content_hash', 'waits': true}}, {{'step': 'thumb', 'waits': thumb_status = 'pending'}}, {{'step': 'dhash', 'waits': thumb_status = 'ready'}}, {{'step': 'embedding', 'waits': thumb_status = 'ready' and embedding_status = 'pending'}},
  {{'step': 'tag', 'waits': thumb_status = 'ready' and tag_status = 'pending'}}, {{'step': 'ocr', 'waits': thumb_status = 'ready' and ocr_status = 'pending'}}, {{'step': 'face', 'waits': thumb_status = 'ready' and face_status = 'pending'}}]) as s from assets_ord where deleted_at is null)
select s.step as step, id from steps where s.waits""")
def pending_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = V.orders(spark, sf_dir)
    steps = ("content_hash", "thumb", "dhash", "embedding", "tag", "ocr", "face")
    return reduce(DataFrame.unionByName, (backlog.pending(assets, step).select(F.lit(step).alias("step"), "id") for step in steps))


@query(f"with {V.ORDERS}, r as (select o_orderkey as id, case when o_custkey % 3 != 0 then 'text ' || o_custkey end as result, case when o_custkey % 3 = 0 then 'broken' end as error from orders where o_orderkey % 2 = 0) select a.id, case when r.id is null then ocr_status when error is null then 'ready' else 'failed' end as ocr_status, result as ocr_text from assets_ord a left join r on a.id = r.id")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = V.read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey as id", "case when o_custkey % 3 != 0 then concat('text ', o_custkey) end as result", "case when o_custkey % 3 = 0 then 'broken' end as error")
    return backlog.merge_results(V.orders(spark, sf_dir), results, "ocr", "ocr_text").select("id", "ocr_status", "ocr_text")


@query("select o_orderkey as id, case when o_orderkey % 7 != 3 then length(o_orderpriority) * 2 end::bigint as result, case when o_orderkey % 7 = 3 then 'failed' end as outcome from orders")
def scored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def score(rows):
        if any(i % 7 == 3 for i in rows["id"]):
            raise ValueError("a bad row spoils its batch")
        return {"id": rows["id"], "result": [None if t is None else len(t) * 2 for t in rows["text"]]}

    chosen = V.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderpriority as text")
    scored = backlog.run_scorer(chosen, score, "long", 16, plain=True)
    return scored.select("id", "result", F.when(F.col("error").isNotNull(), "failed").alias("outcome"))


@query(f"with {V.ORDERS}, chosen as (select id from assets_ord where deleted_at is null and thumb_status = 'ready' and tag_status = 'pending' order by indexed_at, id limit 256) select a.id, case when c.id is null then tag_status when a.id % 5 = 2 then 'failed' else 'ready' end as tag_status from assets_ord a left join chosen c on a.id = c.id")
def enriched_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    def score(rows):
        return rows.assign(result="tagged")[rows["id"] % 5 != 2][["id", "result"]]

    return backlog.enrich_once(V.orders(spark, sf_dir), "tag", score, "string").select("id", "tag_status")


@query("select count(*) as faces, count(*) filter (label % 4 = 1) as unclustered, count(distinct label) filter (label % 4 != 1) as clusters from embeddings")
def face_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.faces(spark, sf_dir)[0]
    return backlog.face_totals(found.withColumn("cluster_id", F.when(F.col("cluster_id") % 4 != 1, F.col("cluster_id"))))


@query("select o_orderkey as id, trim(o_orderstatus) || case when trim(o_orderpriority) != '' then chr(10) || trim(o_orderpriority) else '' end as ocr_text from orders")
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = "array(array('0', concat('  ', o_orderstatus, ' '), '0.9'), array('0', ' '), array('0', '   ', '0.1'), array('1', o_orderpriority, '0.8'))"
    return V.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"{lines} as lines").select("id", backlog.ocr_text(F.col("lines")).alias("ocr_text"))


# --- duplicate groups ------------------------------------------------------------------------


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(groups, items) of equal documents, some of them resolved or dismissed."""
    items = fingerprint.exact_items(V.documents(spark, sf_dir)).select("group_id", F.col("id").alias("image_id"), (1 / (1 + F.col("id") % 3)).alias("similarity"))
    status = "case group_id % 3 when 0 then 'open' when 1 then 'resolved' else 'dismissed' end as status"
    groups = items.select("group_id").distinct().selectExpr("group_id as id", "case when group_id % 2 = 0 then 'exact' else 'phash' end as method", "2.0D as threshold", "group_id as keep_image_id", status, "group_id * 10 as created_at", "cast(null as bigint) as resolved_at")
    return groups, items


_STATE = f"""{V.DOCUMENTS}, {_EXACT}, group_items as (select group_id, id as image_id, 1 / (1 + id % 3)::double as similarity from items),
groups as (select distinct group_id as id, case when group_id % 2 = 0 then 'exact' else 'phash' end as method, case group_id % 3 when 0 then 'open' when 1 then 'resolved' else 'dismissed' end as status from items)"""


@query(f"with {_STATE} select id, method, status, (select count(*) from group_items where group_id = g.id) as item_count from groups g where status = 'open' order by id desc limit 30 offset 2")
def groups_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.groups_page(*_groups(spark, sf_dir), status="open", offset=2, limit=30).select("id", "method", "status", "item_count")


@query(f"with {_STATE} select count(*) as open_groups from groups where status = 'open'")
def open_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.open_groups(_groups(spark, sf_dir)[0])


@query(f"with {_STATE} select id from groups")
def group_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.group_ids(_groups(spark, sf_dir)[0])


@query(f"with {_STATE} select group_id, image_id, filename, row_number() over (partition by group_id order by similarity desc, image_id) as rank from group_items join assets_doc on id = image_id")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.items_of_groups(_groups(spark, sf_dir)[1], V.documents(spark, sf_dir)).select("group_id", "image_id", "filename", "rank")


@query(f"with {_STATE} select id from groups where status = 'open' and method = 'exact' and id in (select group_id from group_items where image_id = (select max(image_id) from group_items where group_id % 6 = 0)) order by id limit 1")
def open_group_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, items = _groups(spark, sf_dir)
    image_id = items.where("group_id % 6 = 0").agg(F.max("image_id")).first()[0]
    return resolve.open_group_of(groups, items, image_id, "exact").select("id")


_PLANNED = f"""{_STATE}, own as (select group_id, image_id from group_items join groups on groups.id = group_id where status = 'open' and method = 'exact'),
live as (select group_id, image_id, width, height, size_bytes, mtime, a.id as id from own join assets_doc a on a.id = image_id where deleted_at is null),
kept as (select group_id, image_id as keep_id from live qualify row_number() over (partition by group_id order by size_bytes desc, width * height desc, mtime desc, id desc) = 1 and count(*) over (partition by group_id) > 1),
gone as (select group_id, image_id, image_id % 4 != 0 as ok from live join kept using (group_id) where image_id != keep_id),
verdict as (select group_id, bool_and(ok) as all_ok, count(*) filter (not ok) as failed from gone group by group_id)"""


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups, items = _groups(spark, sf_dir)
    assets = V.documents(spark, sf_dir)
    plan, _ = resolve.plan_batch(groups, items, assets, "exact", "biggest_file")
    return resolve.apply_plan(plan, assets.selectExpr("id", "id % 4 != 0 as ok"), groups, items, NOW)


@query(f"with {_PLANNED} select g.id, case when all_ok then 'resolved' else status end as status, case when all_ok then keep_id else g.id end as keep_image_id, case when all_ok then {NOW} end as resolved_at from groups g left join verdict v on v.group_id = g.id left join kept k on k.group_id = g.id")
def resolved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir)[0].select("id", "status", "keep_image_id", "resolved_at")


@query(f"with {_PLANNED} select i.group_id, i.image_id from group_items i where not exists (select 1 from gone join verdict using (group_id) where not all_ok and ok and gone.group_id = i.group_id and gone.image_id = i.image_id)")
def items_after_resolving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir)[1].select("group_id", "image_id")


@query(f"with {_PLANNED} select group_id, failed from verdict where not all_ok")
def failed_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir)[2].select("group_id", "failed")


@query(f"with {_STATE} select id, case when status = 'open' then 'dismissed' else status end as status from groups")
def dismissed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, items = _groups(spark, sf_dir)
    plan, _ = resolve.plan_batch(groups, items, V.documents(spark, sf_dir), "all", "", "dismiss")
    return resolve.apply_plan(plan, V.documents(spark, sf_dir).selectExpr("id", "true as ok"), groups, items, NOW)[0].select("id", "status")


@query(f"with {_STATE} select group_id, max(image_id) as keep_id, array_to_string(list_sort(list(image_id) filter (image_id != n)), ',') as trash_ids from (select *, max(image_id) over (partition by group_id) as n from group_items where group_id = (select max(group_id) from group_items)) group by group_id")
def single_group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, items = _groups(spark, sf_dir)
    last = items.agg(F.max_by("group_id", F.struct("group_id", "image_id")).alias("group_id"), F.max_by("image_id", F.struct("group_id", "image_id")).alias("image_id")).first()
    plan = resolve.plan_group(last["group_id"], items, [last["image_id"]])
    return plan.select("group_id", "keep_id", F.array_join(F.col("trash_ids").cast("array<string>"), ",").alias("trash_ids"))


@query(f"with {_STATE}, ends as (select min(id) as target, max(id) as source from groups) select distinct case when group_id = source then target else group_id end as group_id, image_id from (select * from group_items union all select id, id + 1, 0.5 from groups where id % 2 = 0), ends")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, items = _groups(spark, sf_dir)
    more = resolve.add_items(items, groups.where("id % 2 = 0").selectExpr("id as group_id", "id + 1 as image_id", "0.5D as similarity"))
    ends = groups.agg(F.min("id").alias("target"), F.max("id").alias("source")).first()
    return resolve.merge_groups(groups, more, ends["source"], ends["target"])[1].select("group_id", "image_id")


@query(f"""with recursive {_GROUPS}, {_REACH}, {_STATE},
made as (select group_id, (select max(id) from groups) + dense_rank() over (order by group_id) as new_id, id as image_id from members),
stay as (select id from groups where method != 'phash' or status != 'open')
select group_id, image_id from group_items where group_id in (select id from stay) union all select new_id, image_id from made""")
def rebuilt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, items = _groups(spark, sf_dir)
    new = fingerprint.with_similarity(fingerprint.neardup_groups(V.signatures(spark, sf_dir), 5))
    return fingerprint.rebuild_groups(groups, items, new, "phash", 5.0, NOW)[1].select("group_id", "image_id")


@query(f"""with recursive {V.DOCUMENTS}, live_sig as (select s.id, s.dhash from (with {V.SIGNATURES} select * from sig) s join assets_doc using (id) where deleted_at is null), reps as (select min(id) as id, dhash from live_sig group by dhash),
both_ways as (select a.id as a, b.id as b from reps a join reps b on a.id != b.id and bit_count(xor(a.dhash, b.dhash)) <= 2), reach(id, other) as (select id, id from reps union select id, b from reach join both_ways on other = a),
components as (select id, min(other) as group_id from reach group by id), members as (select group_id, s.id, s.dhash from live_sig s join reps using (dhash) join components c on c.id = reps.id qualify count(*) over (partition by group_id) > 1), {_EXACT}
select 'exact' as method, group_id, id, 1.0::double as similarity from items union all select 'phash', group_id, id, 1 - bit_count(xor(dhash, first_value(dhash) over (partition by group_id order by id))) / 64.0::double from members""")
def found_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = V.documents(spark, sf_dir).join(V.signatures(spark, sf_dir), "id", "left")
    return fingerprint.find_groups(assets, "both")


@query(f"with {_STATE} select group_id::varchar as group_id, printf('%.4f', similarity) as similarity, case when image_id = group_id then '1' else '0' end as kept, '/' || lower(n_name) || '/' || filename as path, size_bytes::varchar as size_bytes, content_hash from group_items join assets_doc on id = image_id join nation on n_nationkey = root_id")
def duplicates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, items = _groups(spark, sf_dir)
    assets = V.documents(spark, sf_dir).selectExpr("*", "filename as rel_path", "cast(null as bigint) as dhash")
    return export.duplicates_report(groups, items, assets, _roots(spark, sf_dir)).select("group_id", "similarity", "kept", "path", "size_bytes", "content_hash")


# --- deleting and undoing -----------------------------------------------------------------------


def _deleted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids = V.read(spark, sf_dir, "customer").selectExpr("c_custkey * 7 as id")
    return resolve.soft_delete(V.orders(spark, sf_dir), _roots(spark, sf_dir), ids, NOW)


_ASKED = "asked as (select c_custkey * 7 as id from customer where c_custkey > 0)"


@query(f"with {V.ORDERS}, {_ASKED} select id, case when deleted_at is null and id in (select id from asked) then {NOW} else deleted_at end as deleted_at from assets_ord")
def deleted_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[0].select("id", "deleted_at")


@query(f"with {V.ORDERS}, {_ASKED} select id, 'unknown or deleted' as reason from asked where id not in (select id from assets_ord where deleted_at is null)")
def failed_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[2]


@query(f"with {V.ORDERS}, {_ASKED} select id, '/' || lower(n_name) || '/' || rel_path as path, false as permanent from assets_ord join nation on n_nationkey = root_id where deleted_at is null and id in (select id from asked)")
def undo_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _deleted(spark, sf_dir)[1].withColumn("id", F.lit(1).cast("long"))
    return resolve.undo_items(log).select(F.col("imageId").alias("id"), F.col("originalPath").alias("path"), "permanent")


@query(f"with {V.ORDERS} select id, deleted_at from assets_ord")
def undone_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets, log, _ = _deleted(spark, sf_dir)
    return resolve.undo(assets, log.withColumn("id", F.lit(1).cast("long")), 1, NOW + 5)[0].select("id", "deleted_at")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of an undo log, with their lines as items."""
    items = V.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_partkey").alias("imageId"))).alias("items"))).alias("payload_json"))
    entry = V.read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "'trash' as action", "unix_timestamp(o_orderdate) + 2592000 as can_undo_until", "cast(case when o_orderkey % 3 = 0 then 1 end as bigint) as undone_at", "unix_timestamp(o_orderdate) as created_at")
    return entry.join(items, "id")


@query("with log as (select o_orderkey as id, epoch(o_orderdate)::bigint as created_at, count(*) as item_count from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 3 != 0 group by all) select id, item_count from log order by created_at desc, id desc limit 50")
def undo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.undo_history(_log(spark, sf_dir)).select("id", F.col("item_count").cast("long").alias("item_count"))


@query("select o_orderkey as id from orders where epoch(o_orderdate)::bigint + 2592000 < 850000000 and o_orderkey % 3 != 0 and o_orderkey in (select l_orderkey from lineitem)")
def expired_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.expired_undo(_log(spark, sf_dir), 850_000_000).select("id")


# --- tags, vectors, faces -------------------------------------------------------------------------


@query(f"with {V.TAGS} select name, count(*) as links from links where name = 'ring' group by name")
def tag_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.tag_by_name(table, links, "ring").select("name", "links")


@query(f"with {V.TAGS} select image_id, name, source, score, row_number() over (partition by image_id order by score desc, name, source) as rank from links")
def tags_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.tags_of_image(links, table)


@query(f"with {V.TAGS} select image_id, name from links where source != 'ai'")
def without_machine_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    kept, used, _ = tags.clear_ai_tags(links, table, V.orders(spark, sf_dir))
    return kept.join(used.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("image_id", "name")


@query(f"with {V.ORDERS} select id, case when deleted_at is null and thumb_status = 'ready' then 'pending' else tag_status end as tag_status from assets_ord")
def tagging_starts_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.clear_ai_tags(links, table, V.orders(spark, sf_dir))[2].select("id", "tag_status")


@query(f"with {V.DOCUMENTS} select id as image_id, 'text' as name, 1.0::double as score, 'ocr' as source from assets_doc where trim(coalesce(ocr_text, '')) != ''")
def ocr_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.ocr_tags(V.documents(spark, sf_dir))


@query(f"with {V.TAGS}, {V.DOCUMENTS} select image_id, name, source from links union all select id, 'text', 'ocr' from assets_doc where trim(coalesce(ocr_text, '')) != ''")
def ocr_tag_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    full = table.select("id", "name", F.lit("ai").alias("source"), F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("created_at"))
    all_tags, after = tags.attach_ocr_tags(links.withColumn("created_at", F.lit(0).cast("long")), full, V.documents(spark, sf_dir), NOW)
    return after.join(all_tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("image_id", "name", "source")


@query("""with c as (select p_partkey as id, p_partkey % 17 * 10.0::double as r, p_partkey % 13 * 12.0::double as g, p_partkey % 11 * 14.0::double as b, p_size as w, p_partkey % 50 as h from part),
held as (select id, r > b * 1.08 and r > g as warm, b > r * 1.08 and b > g * 1.02 as blue, g > r * 1.04 and g > b * 1.04 as green, abs(w - h) < 8 as square from c),
named as (select id, unnest(case when blue then ['蓝色', '天空'] else [] end || case when warm then ['暖色', '日落'] else [] end || case when green then ['绿色', '森林'] else [] end || case when square then ['方形'] else [] end || case when not (blue or warm or green or square) then ['照片'] else [] end) as name from held) select id, name from named""")
def colour_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = V.read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_partkey % 17 * 10.0D as r", "p_partkey % 13 * 12.0D as g", "p_partkey % 11 * 14.0D as b", "p_size as w", "p_partkey % 50 as h")
    found = tags.rule_tags(*(F.col(c) for c in "rgbwh"))
    return sides.select("id", F.explode(found).alias("t")).select("id", "t.name")


@query("select count(*) as vectors from embeddings")
def vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_count(V.vectors(spark, sf_dir))


@query("select vec_id as image_id, round(case when vec_id % 2 = 0 then embedding[64] else embedding[1] end::double, 6) as first_value from embeddings where vec_id % 2 = 0 or vec_id % 3 != 0")
def upserted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = V.vectors(spark, sf_dir).select("image_id", "embedding")
    new = stored.where("image_id % 2 = 0").withColumn("embedding", F.reverse("embedding"))
    after = vectors.upsert_vectors(stored.where("image_id % 3 != 0"), new, 64)
    return after.select("image_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(faces, clusters) of the embeddings' labels."""
    found, _ = V.faces(spark, sf_dir)
    clusters = found.select(F.col("cluster_id").alias("id")).distinct().selectExpr("id", "case when id % 3 = 0 then concat('name ', id) end as label", "cast(null as bigint) as sample_image_id", "cast(0 as bigint) as face_count")
    return found, clusters


_FACES = "faces as (select vec_id as id, vec_id % 200 as image_id, label::bigint as cluster_id, (vec_id % 100) / 100.0::double as confidence from embeddings)"


@query(f"with {_FACES} select cluster_id as id, count(*) as face_count, arg_max(image_id, confidence * 10000000 - id) as sample_image_id from faces group by cluster_id")
def refreshed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.refresh_clusters(*_clusters(spark, sf_dir)).select("id", "face_count", "sample_image_id")


@query(f"with {_FACES}, merged as (select case when cluster_id = 4 then 2 else cluster_id end as id, count(*) as face_count from faces group by 1) select id, face_count, case when id = 1 then 'new name' when id % 3 = 0 then 'name ' || id end as label from merged")
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved, clusters = faces.merge_clusters(*_clusters(spark, sf_dir), 4, 2)
    named = faces.rename_cluster(clusters, 1, " new name ")
    return faces.list_clusters(named).select("id", "face_count", "label")


@query(f"with {_FACES} select id, image_id, row_number() over (partition by image_id order by confidence desc, id) as rank from faces")
def faces_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.faces_of_images(V.faces(spark, sf_dir)[0]).select("id", "image_id", "rank")


@query(f"with {_FACES}, {V.TAGGED} select id, filename from assets_part where deleted_at is null and id in (select image_id from faces where cluster_id = 3)")
def images_of_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.images_of_cluster(V.tagged_assets(spark, sf_dir), V.faces(spark, sf_dir)[0], 3).select("id", "filename")


@query(f"""with {_FACES}, fresh as (select p_partkey % 500 as image_id, p_partkey, least(greatest(p_retailprice / 1500.0::double, 0), 1) as confidence, p_size from part where p_partkey % 500 % 4 = 0)
select id, image_id, cluster_id, null::double as w from faces where image_id not in (select image_id from fresh)
union all select (select max(id) from faces) + row_number() over (order by image_id, confidence desc, p_partkey), image_id, null, p_size::double from fresh""")
def replaced_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = V.faces(spark, sf_dir)[0].withColumn("bbox", F.lit(None).cast(schemas.BOX))
    box = "concat('{\"x\":1.0,\"n\":\"', lpad(p_partkey, 12, '0'), '\",\"w\":', p_size, '.0}') as bbox_json"
    new = V.read(spark, sf_dir, "part").where("p_partkey % 500 % 4 = 0").selectExpr("p_partkey % 500 as image_id", box, "p_retailprice / 1500.0D as confidence")
    return faces.replace_faces(old, new).select("id", "image_id", "cluster_id", "bbox.w")


@query("select l_orderkey as order_id, l_linenumber as line, l_quantity as x, l_tax as y, greatest(l_discount * 100 - l_quantity, 0) as w, greatest(0.05::double - l_tax, 0) as h from lineitem")
def corner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = E.box_from_corners(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount") * 100, F.lit(0.05))
    return V.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), box.alias("b")).select("order_id", "line", "b.*")


# --- paths, metadata, events --------------------------------------------------------------------


@query(r"""with p as (select c_custkey as id, case c_custkey % 5 when 0 then ' d:/' || c_name || '/ ' when 1 then '\\nas\' || c_name || '\' when 2 then '/' || c_name || '//' when 3 then c_name else 'e:\' end as path, c_name from customer)
select id, case id % 5 when 0 then 'D:\' || c_name when 1 then '\\nas\' || c_name when 2 then '/' || c_name when 4 then 'E:\' end as normal, case when id % 5 = 1 then 'network' when id % 5 != 3 then 'local' end as type from p""")
def normal_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(r"case c_custkey % 5 when 0 then concat(' d:/', c_name, '/ ') when 1 then concat('\\\\nas\\', c_name, '\\') when 2 then concat('/', c_name, '//') when 3 then c_name else 'e:\\' end")
    normal = files.normal_root(path)
    rows = V.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), normal.alias("normal"))
    return rows.select("id", "normal", F.when(F.col("normal").isNotNull(), files.root_type(F.col("normal"))).alias("type"))


@query("""select o_orderkey as id, case when o_orderkey % 10 != 3 then epoch(o_orderdate)::bigint - 7200 end as taken_at, o_orderkey % 8 as orientation,
case when o_orderkey % 6 = 0 then null else round((case when o_orderkey % 2 = 0 then -1 else 1 end) * (o_orderkey % 90 + 30 / 60.0::double + o_orderkey % 60 / 3600.0::double), 9) end as gps_lat, nullif(trim(o_orderpriority), '') as camera_make from orders""")
def normal_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = "array(named_struct('num', o_orderkey % 90, 'den', cast(1 as bigint)), named_struct('num', cast(30 as bigint), 'den', case when o_orderkey % 6 = 0 then 0L else 1L end), named_struct('num', o_orderkey % 60, 'den', 1L))"
    raw = V.read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderkey % 10 = 3 then 'no date' else date_format(o_orderdate, 'yyyy:MM:dd HH:mm:ss') end as datetime_original", "concat(' ', o_orderpriority, char(0)) as make", "'' as model",
        "array(cast(o_orderkey % 8 as int), 1) as orientations", f"{place} as latitude", "case when o_orderkey % 2 = 0 then ' s' else 'N' end as latitude_ref", f"slice({place}, 1, 2) as longitude", "'E' as longitude_ref",
    )
    return files.normalise_exif(raw, "+02:00").select("id", "taken_at", "orientation", F.round("gps_lat", 9).alias("gps_lat"), "camera_make")


@query("""with roots as (select n_nationkey::bigint as id, '/r' || (n_nationkey % 5) || case when n_nationkey % 2 = 0 then '/sub' else '' end as path, n_regionkey as created_at from nation where n_nationkey % 2 = 0 or n_nationkey % 3 = 0),
e as (select event_id, '/r' || (user_id % 6) || '/' || case when event_id % 2 = 0 then 'sub' else 'subway' end || '/' || event_id || '.jpg' as path from events)
select event_id, r.id as root_id from e join roots r on starts_with(e.path, r.path || '/') qualify row_number() over (partition by event_id order by created_at, r.id) = 1""")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = V.read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id", "concat('/r', n_nationkey % 5, case when n_nationkey % 2 = 0 then '/sub/' else '' end) as path", "cast(n_regionkey as bigint) as created_at", "n_nationkey % 2 = 0 or n_nationkey % 3 = 0 as enabled", "'local' as type")
    happened = V.read(spark, sf_dir, "events").selectExpr("event_id", "concat('/r', user_id % 6, '/', case when event_id % 2 = 0 then 'sub' else 'subway' end, '/', event_id, '.jpg') as path")
    return events.route_events(happened, roots).select("event_id", "root_id")


@query("select event_id, case event_type when 'click' then 'create' when 'view' then 'modify' else 'remove' end as kind from events where event_type in ('click', 'view', 'purchase')")
def watched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.watched(V.file_events(spark, sf_dir)).select("event_id", "kind")


@query("select n_nationkey::bigint as id from nation where n_nationkey % 2 = 0 and n_regionkey % 2 = 1")
def skipped_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = _roots(spark, sf_dir).withColumn("type", F.when(F.col("created_at") % 2 == 1, "network").otherwise(F.col("type")))
    return events.skipped_roots(network).select("id")


@query(f"with {V.ORDERS}, {V.TAGS} select 'assets' as table, 'table' as kind, count(*) as rows from assets_ord union all select 'links', 'table', count(*) from links union all select 'vectors', 'table', count(*) from embeddings")
def restored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a snapshot whose tables were restored by it."""
    path = graph.fresh_path(spark, "snapshot")
    held = {"assets": V.orders(spark, sf_dir), "links": V.tags(spark, sf_dir)[1], "vectors": V.vectors(spark, sf_dir)}
    manifest = export.export_snapshot(held, path)
    back = export.restore_snapshot(spark, path, graph.fresh_path(spark, "staging"))
    counts = reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in back.items()))
    return manifest.select("table", "kind").join(counts, "table")
