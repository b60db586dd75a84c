"""The operators as named queries over the driver's tables, each with the SQL for the same rows where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import backlog, browse, buckets, faces, fingerprint, graph, reconcile, resolve, rollup, tags, textindex, textsearch, vectors
from ..streaming import events
from . import registry
from . import views as V
from .registry import NOW, query

TZ = "+02:00"
_PAGE = browse.BrowseParams(formats=(".O", "f"), text="img_1", size_min=50_000, size_max=200_000, has_gps=True, sort="taken_at", offset=20, limit=100)
_LOCAL = "to_timestamp(coalesce(taken_at, mtime) + 7200)"


# --- browse -------------------------------------------------------------------------

_WHERE = "deleted_at is null and extension in ('o', 'f') and contains(lower(filename), 'img_1') and size_bytes between 50000 and 200000 and gps_lat is not null and gps_lng is not null"


@query(f"with {V.DOCUMENTS} select id, filename, size_bytes from assets_doc where deleted_at is null and extension in ('en', 'de') and contains(lower(filename), 'doc_1') and size_bytes between 200 and 5000 order by mtime desc, id desc limit 100")
def browse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = browse.BrowseParams(formats=("en", ".DE"), text="DOC_1", size_min=200, size_max=5000, limit=100)
    return browse.browse(V.documents(spark, sf_dir), p).select("id", "filename", "size_bytes")


@query(f"with {V.ORDERS}, {V.ROOTS} select a.id, path || rel_path as full_path, coalesce(taken_at, mtime) as shown_at from (select * from assets_ord where {_WHERE} order by coalesce(taken_at, mtime) desc, id desc limit 100 offset 20) a join roots r on a.root_id = r.id")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.browse(V.orders(spark, sf_dir), _PAGE, V.roots(spark, sf_dir)).select("id", "full_path", E.shown_at().alias("shown_at"))


_ORDERS = {"taken_at": "coalesce(taken_at, mtime)", "filename": "lower(filename)", "size_bytes": "size_bytes", "mtime": "mtime"}


@query(f"with {V.ORDERS} " + " union all ".join(f"(select '{key}' as sort, '{way}' as direction, id, row_number() over (order by {by} {way}, id {way}) as place from assets_ord where deleted_at is null and extension in ('o', 'f') qualify place between 6 and 105)" for key, by in _ORDERS.items() for way in ("asc", "desc")))
def browse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each of the eight orders."""
    pages = []
    for key in browse.SORT_KEYS:
        for way in ("asc", "desc"):
            p = browse.BrowseParams(formats=("o", "f"), sort=key, direction=way, offset=5, limit=100)
            place = F.row_number().over(Window.orderBy(*browse.ordering(p))) + p.offset  # a page's rows
            pages.append(browse.browse(V.orders(spark, sf_dir), p).select(F.lit(key).alias("sort"), F.lit(way).alias("direction"), "id", place.alias("place")))
    return reduce(DataFrame.unionByName, pages)


@query(f"with {V.ORDERS} select count(*) as total from assets_ord where {_WHERE}")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page_total(V.orders(spark, sf_dir), _PAGE)


@query(f"with {V.ORDERS} select id, min(l_partkey) as pos from assets_ord join lineitem on id = l_orderkey where deleted_at is null group by id")
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.read(spark, sf_dir, "lineitem").selectExpr("l_partkey as pos", "l_orderkey as id")
    return browse.by_ids(V.orders(spark, sf_dir), ids).select("id", "pos")


@query(f"""with {V.ORDERS}, albums as (select s_suppkey as id, s_nationkey % 8 as root_id, s_acctbal::bigint * 10 as size_min, case when s_suppkey % 3 = 0 then 'f' end as format, s_suppkey % 4 = 0 as everywhere from supplier)
select albums.id as album_id, count(a.id) as members from albums left join assets_ord a on a.deleted_at is null and (everywhere or a.root_id = albums.root_id) and (format is null or extension = format) and a.size_bytes >= greatest(size_min, 0) and a.gps_lat is not null group by albums.id""")
def album_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = F.when(F.col("s_suppkey") % 4 != 0, F.array((F.col("s_nationkey") % 8).cast("long")))
    # halves to the even number, as the cast of a double in SQL does
    filter_json = F.to_json(F.struct(roots.alias("rootIds"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(".F"))).alias("formats"), (F.rint("s_acctbal").cast("long") * 10).alias("sizeMin"), F.lit(True).alias("hasGps")))
    albums = V.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), filter_json.alias("filter_json"))
    return browse.album_counts(V.orders(spark, sf_dir), albums).select("album_id", "members")


_CUSTOMER_ALBUMS = """albums as (select c_custkey as id, case when c_custkey % 4 = 1 then c_nationkey % 8 end as root_id, case c_custkey % 5 when 1 then 'f' when 2 then 'o' end as format, case when c_custkey % 70 = 3 then 'img_1' else '' end as text,
  case when c_custkey % 3 = 0 then c_acctbal::bigint * 20 end as size_min, case when c_custkey % 2 = 0 then 100000 + c_acctbal::bigint * 20 end as size_max,
  case when c_custkey % 3 != 1 then 700000000 + c_custkey * 4099 % 200000000 end as taken_from, case when c_custkey % 6 != 2 then 720000000 + c_custkey * 7919 % 200000000 end as taken_to, case c_custkey % 11 when 0 then true when 1 then false end as has_gps, c_custkey % 13 = 0 as deleted from customer)"""


@query(f"""with {V.ORDERS}, {_CUSTOMER_ALBUMS},
taken as (select b.id, count(*) as n from albums b join assets_ord a on (root_id_of is null or a.root_id = root_id_of) and (format is null or extension = format) and contains(lower(filename), text) and size_bytes >= greatest(coalesce(size_min, 0), 0) and (size_max is null or size_bytes <= greatest(size_max, 0))
  and (taken_from is null or coalesce(taken_at, mtime) >= taken_from) and (taken_to is null or coalesce(taken_at, mtime) <= taken_to) and (has_gps is null or has_gps = (gps_lat is not null and gps_lng is not null)) and (deleted or deleted_at is null) group by b.id)
select albums.id as album_id, coalesce(n, 0) as members from albums left join taken using (id)""".replace("case when c_custkey % 4 = 1 then c_nationkey % 8 end as root_id", "case when c_custkey % 4 = 1 then c_nationkey % 8 end as root_id_of"))
def customer_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An album for each customer, with every mixture of bounds."""
    key = F.col("c_custkey")
    balance = F.rint("c_acctbal").cast("long") * 20
    parts = {
        "rootIds": F.when(key % 4 == 1, F.array((F.col("c_nationkey") % 8).cast("long"))), "formats": F.when(key % 5 == 1, F.array(F.lit("F"))).when(key % 5 == 2, F.array(F.lit(".o"))),
        "q": F.when(key % 70 == 3, " IMG_1 "), "sizeMin": F.when(key % 3 == 0, balance), "sizeMax": F.when(key % 2 == 0, 100000 + balance),
        "takenFrom": F.when(key % 3 != 1, 700000000 + key * 4099 % 200000000), "takenTo": F.when(key % 6 != 2, 720000000 + key * 7919 % 200000000),
        "hasGps": F.when(key % 11 == 0, True).when(key % 11 == 1, False), "includeDeleted": key % 13 == 0,
    }
    filter_json = F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))
    albums = V.read(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_name").alias("name"), filter_json.alias("filter_json"))
    return browse.album_counts(V.orders(spark, sf_dir), albums).select("album_id", "members")


@query(f"with {V.ORDERS} select id, case when size_bytes >= 1048576 then printf('%.1f MB', round(size_bytes / 1048576.0::double, 1)) when size_bytes / 1024.0 >= 10 then round(size_bytes / 1024.0::double)::bigint || ' KB' when size_bytes >= 1024 then printf('%.1f KB', round(size_bytes / 1024.0::double, 1)) else size_bytes || ' B' end as size_text from assets_ord")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.orders(spark, sf_dir).select("id", E.human_bytes(F.col("size_bytes")).alias("size_text"))


# --- roll-ups ------------------------------------------------------------------------


@query(f"with {V.ORDERS} select year({_LOCAL})::int as year, month({_LOCAL})::int as month, count(*) as assets, min(coalesce(taken_at, mtime)) as first_at, max(coalesce(taken_at, mtime)) as last_at from assets_ord where deleted_at is null group by 1, 2 order by 1 desc, 2 desc limit 120".replace("to_timestamp(", "make_timestamp(1000000 * (").replace("7200)", "7200))"))
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.timeline(V.orders(spark, sf_dir), TZ)


def _three_changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four states of the orders' assets, the last the present one; each differs from the next by additions, by times and statuses, by deletions."""
    now = V.orders(spark, sf_dir)
    alive = now.withColumn("deleted_at", F.when(F.col("id") % 17 != 0, F.col("deleted_at")))
    moved = alive.withColumns({"taken_at": F.when(F.col("id") % 11 == 0, F.col("mtime") + 40 * 86_400).otherwise(F.col("taken_at")), "tag_status": F.when(F.col("id") % 11 == 0, "pending").otherwise(F.col("tag_status"))})
    return [moved.where("id % 10 != 7"), moved, alive, now]


def _change_sets(states: list[DataFrame]) -> list[tuple[DataFrame, DataFrame]]:
    """(before, after) of the changed assets between neighbouring states of ``_three_changes``."""
    changed = ("id % 10 = 7", "id % 11 = 0", "id % 17 = 0")
    return [(a.where(c), b.where(c)) for a, b, c in zip(states, states[1:], changed, strict=False)]


@query(registry.ORACLE_SQL["timeline"])
def kept_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline from kept months, after three change sets."""
    states = _three_changes(spark, sf_dir)
    months, moments = (graph.written(df) for df in rollup.kept_timeline(states[0], TZ))
    for before, after in _change_sets(states):
        months, moments = (graph.written(df) for df in rollup.updated_timeline(months, moments, before, after, TZ))
    return rollup.newest_months(months)


@query(f"with {V.ORDERS}, dated as (select id, coalesce(taken_at, mtime) as shown_at, make_timestamp(1000000 * (coalesce(taken_at, mtime) + 7200)) as t from assets_ord where deleted_at is null) select id, year(t)::int as year, month(t)::int as month, shown_at, row_number() over (partition by year(t), month(t) order by shown_at desc, id desc) as rank from dated qualify rank <= 50")
def timeline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.timeline_samples(V.orders(spark, sf_dir), TZ)


@query(f"with {V.ORDERS} select id, gps_lat, gps_lng, coalesce(taken_at, mtime) as shown_at from assets_ord where deleted_at is null and gps_lat is not null order by 4 desc, 1 desc limit 2000")
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.map_points(V.orders(spark, sf_dir))


@query(f"with {V.ORDERS} select min(gps_lat) as min_lat, max(gps_lat) as max_lat, min(gps_lng) as min_lng, max(gps_lng) as max_lng from assets_ord")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.map_bounds(V.orders(spark, sf_dir))


@query(f"with {V.ORDERS} select count(*) as assets, coalesce(sum(size_bytes), 0)::bigint as bytes from assets_ord where id in (select l_orderkey from lineitem where l_quantity > 45)")
def selection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = V.read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return rollup.selection_stats(V.orders(spark, sf_dir), chosen)


# --- tags ---------------------------------------------------------------------------


@query(f"with {V.TAGS} select name, count(*) as links from links group by name order by links desc, name limit 500")
def tag_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.tag_cloud(table, links).select("name", "links")


@query(f"with {V.TAGS} select image_id from links where name in ('small', 'ring') group by image_id having count(distinct name) = 2")
def tag_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.images_with_all(links, table, ["small", "ring", "small"])


@query(f"with {V.TAGS}, lists as (select distinct p_partkey as list_id, unnest(string_split(p_name, ' ')[1:2] || [p_type][1:(p_partkey % 2)::int]) as name from part), sizes as (select list_id, count(*) as n from lists group by list_id), carried as (select distinct image_id, name from links), met as (select list_id, image_id from lists join carried using (name) join sizes using (list_id) group by all having count(*) = any_value(n)) select list_id, count(*) as images from met group by list_id")
def tag_lists_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the images that carry the first two words of its name, and for every other one its type too."""
    _, links = V.tags(spark, sf_dir)
    names = F.concat(F.slice(F.split("p_name", " "), 1, 2), F.when(F.col("p_partkey") % 2 == 1, F.array("p_type")).otherwise(F.array().cast("array<string>")))
    lists = V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("list_id"), F.explode(names).alias("name")).select("list_id", F.xxhash64("name").alias("tag_id"))
    return tags.counts_of_lists(graph.written(tags.tag_bitmaps(links)), lists)


@query(f"with {V.TAGS}, {V.TAGGED} select id, max(score) as score, any_value(mtime) as mtime from links join assets_part on id = image_id where name = 'small' and deleted_at is null group by id order by score desc, mtime desc, id desc limit 200")
def images_of_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.images_of_tag(V.tagged_assets(spark, sf_dir), links, table, "small")


@query(f"with {V.TAGS}, {V.TAGGED} select name, count(distinct id) as images from links left join assets_part on id = image_id and deleted_at is null group by name")
def images_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.images_of_tag_total(V.tagged_assets(spark, sf_dir), links, table).select("name", "images")


@query(f"with {V.TAGS}, best as (select image_id, name, max(score) as score from links group by all) select image_id, name, score, row_number() over (partition by image_id order by score desc, name) as rank from best qualify rank <= 12")
def best_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    return tags.best_per_tag(tags.with_names(links, table))


@query(f"with {V.TAGS} select image_id, name, source, score from links where source != 'ai' or image_id % 3 != 0 union all select p_partkey, 'new ' || p_brand, 'ai', least(greatest(p_retailprice / 1500.0::double, 0), 1) from part where p_partkey % 3 = 0")
def replace_ai_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    dated = lambda df: df.withColumn("created_at", F.lit(0).cast("long"))
    full = table.select("id", "name", F.lit("ai").alias("source"), F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("created_at"))
    new = V.read(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey as image_id", "concat(' new ', p_brand, ' ') as name", "p_retailprice / 1500.0D as score", "cast(null as string) as category")
    all_tags, out = tags.replace_ai_tags(dated(links), full, new, NOW)
    return out.join(all_tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("image_id", "name", "source", "score")


@query("""with parts as (select p_partkey as id, list_filter(list_transform(string_split(p_name || '|' || p_type || '|' || p_brand || '|' || p_type, '|'), lambda x: trim(x)), lambda x: x != '') as w from part)
select id, name, round(greatest(0.5, 0.95 - 0.01 * (place - 1)), 3)::double as score from (select id, unnest(list_distinct(w)) as name, w from parts) join lateral (select list_position(w, name) as place) on true""")
def split_tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("｜", "p_name", F.concat(F.lit(" "), F.col("p_type")), "p_brand", "p_type")
    scored = F.explode(tags.rank_scores(tags.split_tags(text)))
    return V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scored.alias("t")).select("id", "t.name", "t.score")


_CENTROIDS = "centroids as (select label, list(m order by d) as c from (select label, d, avg(embedding[d]::double) as m from embeddings, range(1, 65) t(d) group by all) group by label)"


@query(f"with {_CENTROIDS}, scored as (select vec_id as image_id, 'label ' || c.label as name, round(least(greatest((list_sum(list_transform(list_zip(embedding, c), lambda x: x[1]::double * x[2])) + 1) / 2, 0), 1), 6) as score from embeddings, centroids c) select image_id, name, score, row_number() over (partition by image_id order by score desc, name) as rank from scored qualify rank <= 8")
def zero_shot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.vectors(spark, sf_dir)
    means = found.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    sorted_means = F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"])
    prompts = means.groupBy("label").agg(sorted_means.alias("embedding")).select(F.concat(F.lit("label "), F.col("label")).alias("name"), "embedding")
    return tags.zero_shot(found, prompts, digits=6)  # the rank by the rounded score, as the SQL has it


# --- reconciliation -------------------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.classify(V.orders(spark, sf_dir), V.listing(spark, sf_dir))


@query(f"with {V.ORDERS}, {V.LISTING} select root_id, rel_path, change from classified")
def reconcile_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("root_id", "rel_path", "change")


@query(f"with {V.ORDERS}, {V.LISTING} select root_id, count(*) filter (change = 'added') as added, count(*) filter (change in ('updated', 'restored')) as updated, count(*) filter (change = 'removed') as removed, count(*) filter (change in ('added', 'updated', 'restored', 'unchanged')) as total from classified group by root_id")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.scan_summary(_classified(spark, sf_dir))


@query(f"""with {V.ORDERS}, {V.LISTING}
select a.id, a.root_id, a.rel_path, case when c.change in ('updated', 'restored') then c.size_bytes else a.size_bytes end as size_bytes,
  case when c.change in ('updated', 'restored') then 'pending' else a.thumb_status end as thumb_status, case when c.change in ('updated', 'restored') then 'disabled' else a.ocr_status end as ocr_status,
  case when c.change = 'removed' then {NOW} when c.change in ('updated', 'restored') then null else a.deleted_at end as deleted_at
from assets_ord a join classified c on a.id = c.id
union all
select (select max(id) from assets_ord) + row_number() over (order by root_id, rel_path), root_id, rel_path, size_bytes, 'pending', 'disabled', null from classified where change = 'added'""")
def reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = reconcile.apply_changes(V.orders(spark, sf_dir), _classified(spark, sf_dir), NOW)
    return after.select("id", "root_id", "rel_path", "size_bytes", "thumb_status", "ocr_status", "deleted_at")


@query(registry.ORACLE_SQL["reconcile_apply"])
def reconcile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from catalog and listing in buckets, by one join that moves neither."""
    prev, listing = buckets.write_buckets(V.orders(spark, sf_dir), "assets"), buckets.write_buckets(V.listing(spark, sf_dir), "listing")
    after = buckets.next_version(prev, listing, NOW)
    return after.select("id", "root_id", "rel_path", "size_bytes", "thumb_status", "ocr_status", "deleted_at")


@query(f"with {V.ORDERS}, counted as (select unnest([{{'step': 'embedding', 'status': case when thumb_status = 'ready' then embedding_status end}}, {{'step': 'tag', 'status': case when thumb_status = 'ready' then tag_status end}}, {{'step': 'ocr', 'status': ocr_status}}, {{'step': 'face', 'status': face_status}}]) as s from assets_ord where deleted_at is null) select s.step as step, s.status as status, count(*) as assets from counted where s.status is not null group by all")
def backlog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.backlog_counts(V.orders(spark, sf_dir))


@query(registry.ORACLE_SQL["backlog_counts"])
def kept_backlog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backlog's counts, kept and brought up to date by three change sets."""
    states = _three_changes(spark, sf_dir)
    keys = ["step", "status"]
    kept = backlog.step_statuses(states[0]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    for before, after in _change_sets(states):
        kept = rollup.changed_counts(graph.written(kept), backlog.step_statuses(before), backlog.step_statuses(after), keys)
    return kept.withColumnRenamed("n", "assets")


@query(f"with {V.ORDERS}, chosen as (select id, row_number() over (order by indexed_at, id) - 1 as n from assets_ord where deleted_at is null and thumb_status = 'ready' and tag_status = 'pending' order by indexed_at, id limit 256) select id, (n // 16)::bigint as batch from chosen")
def tag_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.in_batches(backlog.backlog(V.orders(spark, sf_dir), "tag"), "tag").select("id", "batch")


@query(f"with {V.ORDERS} select id, case when deleted_at is null and thumb_status = 'ready' and ocr_status in ('disabled', 'failed') then 'pending' else ocr_status end as ocr_status from assets_ord")
def mark_ocr_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.mark_pending(V.orders(spark, sf_dir), "ocr_status").select("id", "ocr_status")


@query(f"with {V.ORDERS} select id, case when orientation in (6, 8) then height else width end as width, case when orientation in (6, 8) then width else height end as height from assets_ord")
def oriented_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = E.oriented(F.col("width"), F.col("height"), F.col("orientation"))
    return V.orders(spark, sf_dir).select("id", side.alias("s")).select("id", "s.width", "s.height")


# --- duplicates ----------------------------------------------------------------------

_EXACT = "grouped as (select content_hash, min(id) as group_id from assets_doc where deleted_at is null group by content_hash having count(*) > 1), items as (select group_id, id from assets_doc join grouped using (content_hash) where deleted_at is null)"


@query(f"with {V.DOCUMENTS}, {_EXACT} select group_id, id from items")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.exact_items(V.documents(spark, sf_dir))


def _exact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.exact_items(V.documents(spark, sf_dir)).select("group_id", F.col("id").alias("image_id"), F.lit(1.0).alias("similarity"))


_KEEP = {
    "largest": "width * height desc, size_bytes desc, mtime desc, id desc",
    "newest": "mtime desc, width * height desc, size_bytes desc, id desc",
    "biggest_file": "size_bytes desc, width * height desc, mtime desc, id desc",
    "shortest_name": "length(filename), width * height desc, size_bytes desc, mtime desc, id",
}


@query(f"with {V.DOCUMENTS}, {_EXACT} " + " union all ".join(f"(select '{rule}' as rule, group_id, id as keep_id from items join assets_doc using (id) qualify row_number() over (partition by group_id order by {order}) = 1)" for rule, order in _KEEP.items()))
def keep_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, assets = _exact_items(spark, sf_dir), V.documents(spark, sf_dir)
    chosen = [resolve.choose_keep(items, assets, rule).select(F.lit(rule).alias("rule"), "group_id", "keep_id") for rule in resolve.RULES]
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


@query(f"with {V.DOCUMENTS}, {_EXACT} select group_id, id as keep_id from items join assets_doc using (id) qualify row_number() over (partition by group_id order by width::hugeint * height * 1000000000 + size_bytes::hugeint * 1000 + mtime desc, id) = 1")
def suggested_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.suggest_keep(_exact_items(spark, sf_dir), V.documents(spark, sf_dir))


@query(f"with {V.DOCUMENTS}, {_EXACT}, ranked as (select group_id, id, row_number() over (partition by group_id order by {_KEEP['largest']}) as n from items join assets_doc using (id)) select group_id, max(id) filter (n = 1) as keep_id, array_to_string(list_sort(list(id) filter (n > 1)), ',') as trash_ids from ranked group by group_id")
def resolve_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _exact_items(spark, sf_dir)
    groups = items.select(F.col("group_id").alias("id")).distinct().withColumns({"method": F.lit("exact"), "status": F.lit("open")})
    plan, _ = resolve.plan_batch(groups, items, V.documents(spark, sf_dir), "exact", "largest")
    return plan.select("group_id", "keep_id", F.array_join(F.col("trash_ids").cast("array<string>"), ",").alias("trash_ids"))


_GROUPS = f"""{V.SIGNATURES}, reps as (select min(id) as id, dhash from sig group by dhash),
pairs as (select a.id as a, b.id as b, bit_count(xor(a.dhash, b.dhash))::bigint as distance from reps a join reps b on a.id < b.id where bit_count(xor(a.dhash, b.dhash)) <= 5)"""
_REACH = """both_ways as (select a, b from pairs union all select b, a from pairs),
reach(id, other) as (select id, id from reps union select id, b from reach join both_ways on other = a),
components as (select id, min(other) as group_id from reach group by id),
members as (select group_id, sig.id, sig.dhash from sig join reps using (dhash) join components c on c.id = reps.id qualify count(*) over (partition by group_id) > 1)"""


@query(f"with {_GROUPS} select a, b, distance from pairs")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.hamming_pairs(V.signatures(spark, sf_dir), 5).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query(f"with recursive {_GROUPS}, {_REACH} select group_id, id, 1 - bit_count(xor(dhash, first_value(dhash) over (partition by group_id order by id))) / 64.0::double as similarity from members")
def neardup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_similarity(fingerprint.neardup_groups(V.signatures(spark, sf_dir), 5))


@query(f"with recursive {_GROUPS}, {_REACH} select group_id, id, 1 - bit_count(xor(dhash, first_value(dhash) over (partition by group_id order by id))) / 64.0::double as similarity from members")
def extended_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all signatures, of which those of some ids came later, in two parts."""
    own = graph.written(V.signatures(spark, sf_dir))
    late = F.pmod(F.xxhash64("id"), F.lit(10))
    members, keys = fingerprint.grouped_hashes(own.where(late > 1), 5)
    for part in (0, 1):
        members, keys = (graph.written(df) for df in fingerprint.extend_groups(members, keys, own.where(late == part), 5))
    several = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    return fingerprint.with_similarity(members.join(several, "group_id"))


@query(f"with {V.SIGNATURES} select p.id as probe_id, s.id, bit_count(xor(p.dhash, s.dhash))::bigint as distance from sig p join sig s on bit_count(xor(p.dhash, s.dhash)) <= 7 where p.id % 20 = 0")
def hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = graph.written(V.signatures(spark, sf_dir))
    probes = own.where("id % 20 = 0").select(F.col("id").alias("probe_id"), "dhash")
    return fingerprint.hamming_search(own, probes, 7).select("probe_id", "id", F.col("distance").cast("long").alias("distance"))


@query(f"""with recursive {V.DOCUMENTS}, {_GROUPS}, {_REACH}, truth as (select id, dense_rank() over (order by content_hash) as t from assets_doc), algo as (select id, group_id as g from members), c2 as (
  select (select sum(n * (n - 1) / 2) from (select count(*) as n from truth join algo using (id) group by t, g)) as tp, (select sum(n * (n - 1) / 2) from (select count(*) as n from algo group by g)) as p, (select sum(n * (n - 1) / 2) from (select count(*) as n from truth group by t)) as q)
select tp::bigint as tp, (p - tp)::bigint as fp, (q - tp)::bigint as fn, tp / p::double as precision, tp / q::double as recall, 2 * (tp / p::double) * (tp / q::double) / (tp / p::double + tp / q::double) as f1 from c2""")
def grouping_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = V.documents(spark, sf_dir).select("id", F.col("content_hash").alias("grp"))
    algo = fingerprint.neardup_groups(V.signatures(spark, sf_dir), 5).select("id", F.col("group_id").alias("grp"))
    return fingerprint.pairwise_quality(truth, algo)


# --- text and vectors -------------------------------------------------------------------

def _tokens(keep: str = "true") -> str:
    """SQL of what the searches find among the documents' assets for which ``keep`` holds."""
    return f"""{V.DOCUMENTS}, held as (select * from assets_doc where {keep}),
tok as (select id, 0 as col, list_filter(regexp_split_to_array(lower(strip_accents(filename)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '') as w from held
  union all select id, 1, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(ocr_text, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '') from held),
sizes as (select id, sum(len(w)) as tokens from tok group by id), numbers as (select count(*) as docs, avg(tokens) as average from sizes),
asked as (select id as query_id, unnest([1, 2]) as phrase, unnest(w[1:2]) as token from tok where col = 1 and id % 20 = 0 and len(w) >= 2),
hits as (select query_id, phrase, id, sum(len(list_filter(w, lambda x: x = token))) as tf from tok, asked where list_contains(w, token) group by all),
spread as (select query_id, phrase, count(*) as df from hits group by all),
scored as (select query_id, id, sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tokens / average))) as score, count(*) as n
  from hits join spread using (query_id, phrase) join sizes using (id), numbers group by all),
found as (select query_id, id, round(score, 6) as score, count(*) over (partition by query_id) as total from scored join held using (id) where n = 2 and deleted_at is null)"""


def _searches(spark: SparkSession, sf_dir: str, keep: str = "true") -> tuple[DataFrame, DataFrame]:
    """(assets, queries): the first two words of every document whose id is divisible by 20."""
    assets = V.documents(spark, sf_dir).where(keep)
    first = F.slice(textsearch.words(F.col("ocr_text")), 1, 2)
    return assets, assets.where("id % 20 = 0").select(F.col("id").alias("query_id"), first.alias("w")).where("size(w) = 2").select("query_id", F.array_join("w", " ").alias("query"))


@query(f"with {_tokens()} select * from found")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.search(*_searches(spark, sf_dir), limit=None).select("query_id", "id", "score", "total")  # rounded there


@query(f"with {_tokens()} select query_id, id, score, total from found qualify row_number() over (partition by query_id order by score desc, id) between 4 and 13")
def text_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets, queries = _searches(spark, sf_dir)
    return textsearch.search(assets, queries, 10, 3).select("query_id", "id", "score", "total")


_TEN = "select query_id, id, score, total, row_number() over (partition by query_id order by score desc, id) as rank from found qualify rank <= 10"


@query(f"with {_tokens()} {_TEN}")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets, queries = _searches(spark, sf_dir)
    path = graph.fresh_path(spark, "text-index")
    textindex.write_index(assets, path)
    return textindex.search_index(spark, path, queries, 10).select("query_id", "id", "score", "total", "rank")


@query(f"with {_tokens('id % 9 != 4')} {_TEN}")
def indexed_search_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an earlier state, brought up to date by what was added, changed, deleted and removed since."""
    now, queries = _searches(spark, sf_dir, "id % 9 != 4")
    text = F.when(F.col("id") % 11 == 0, F.concat(F.lit("other words once "), F.col("ocr_text"))).otherwise(F.col("ocr_text"))
    alive = F.when((F.col("id") % 26 == 0), F.lit(None)).otherwise(F.col("deleted_at"))
    earlier = V.documents(spark, sf_dir).where("id % 10 != 7").withColumns({"ocr_text": text, "deleted_at": alive})
    changed = "id % 9 = 4 or id % 11 = 0 or id % 26 = 0"
    path = graph.fresh_path(spark, "text-index")
    textindex.write_index(earlier, path)
    textindex.update_index(path, earlier.where(changed), now.where(f"id % 10 = 7 or {changed}"))
    return textindex.search_index(spark, path, queries, 10).select("query_id", "id", "score", "total", "rank")


_DISTANCE = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"


@query(f"with found as (select q.vec_id as query_id, v.vec_id as image_id, {_DISTANCE} as distance from embeddings v, embeddings q where q.vec_id % 20 = 0) select query_id, image_id, round(distance, 6) as distance, round(1 / (1 + distance), 6) as score, row_number() over (partition by query_id order by distance, image_id) as rank from found qualify rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = V.vectors(spark, sf_dir)
    asked = stored.where("image_id % 20 = 0").select(F.col("image_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.top_k(stored, asked, 10).select("query_id", "image_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


@query(f"with {V.ORDERS} select a.id, case when e.vec_id is null then a.embedding_status when e.vec_id % 3 = 0 then 'failed' else 'ready' end as embedding_status, case when e.vec_id % 3 != 0 then round(list_sum(list_transform(e.embedding, lambda x: 2 * x::double)), 4) when e.vec_id % 2 = 0 then round(list_sum(list_transform(e.embedding, lambda x: x::double)), 4) end as total from assets_ord a left join embeddings e on e.vec_id = a.id")
def vector_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of doubled vectors, every third of them missing, written over a store that has every other one."""
    stored = V.vectors(spark, sf_dir).select("image_id", "embedding")
    doubled = F.when(F.col("image_id") % 3 != 0, F.transform("embedding", lambda x: 2 * x))
    assets, after = vectors.write_back(V.orders(spark, sf_dir), stored.where("image_id % 2 = 0"), stored.select(F.col("image_id").alias("id"), doubled.alias("result")), 64)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double")), 4)
    return assets.select("id", "embedding_status").join(after.select(F.col("image_id").alias("id"), total.alias("total")), "id", "left")


@query(f"with found as (select q.vec_id as query_id, v.vec_id as image_id, {_DISTANCE} as distance from embeddings v, embeddings q where q.vec_id % 20 = 0 and v.vec_id != q.vec_id) select query_id, image_id, row_number() over (partition by query_id order by distance, image_id) as rank from found qualify rank <= 40")
def similar_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = V.vectors(spark, sf_dir)
    return vectors.similar_to(stored, stored.where("image_id % 20 = 0")).select("query_id", "image_id", "rank")


@query("""with parts as (select o_orderkey as query_id, ['#' || lower(o_orderstatus), 'sun', 'size:>' || (o_custkey % 50) || 'KB', 'size:<=' || (o_custkey % 7 + 1) || 'MB', 'format:.' || o_orderstatus, 'set', '#x', 'size:abc'] as w from orders)
select query_id, 'sun set' as text, w[1][2:] || ',x' as tags, lower(w[5][9:]) as format, (1024 * replace(w[3][7:], 'KB', '')::bigint) as size_min, 1048576 * replace(w[4][8:], 'MB', '')::bigint as size_max from parts""")
def parsed_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('#', lower(o_orderstatus), ' sun  size:>', o_custkey % 50, 'KB size:<=', o_custkey % 7 + 1, 'MB format:.', o_orderstatus, ' set #x size:abc #x')"
    parsed = vectors.parse_search(V.read(spark, sf_dir, "orders").selectExpr("o_orderkey as query_id", f"{text} as query"))
    return parsed.withColumn("tags", F.array_join("tags", ","))


@query(f"""with {V.TAGS}, {V.TAGGED}, asked as (select vec_id as query_id, case when vec_id % 60 = 0 then null else embedding end as embedding, vec_id % 40 = 20 as bare, p.word as word, case when vec_id % 60 = 0 then p.word else 'some' end as text, 10 + vec_id % 7 as least
  from embeddings join (select p_partkey, string_split(p_name, ' ')[1] as word from part) p on p_partkey = vec_id % (select count(*) from part) + 1 where vec_id % 20 = 0),
met as (select a.query_id, p.id, p.filename, p.mtime, bare, text, a.embedding from asked a join links l on l.name = a.word join assets_part p on p.id = l.image_id where p.deleted_at is null and p.size_bytes >= least group by all),
found as (select query_id, id, {{distance}} as distance from met q join embeddings v on v.vec_id = q.id where not bare and q.embedding is not null),
ranked as (select query_id, id, round(1 / (1 + distance), 6) as score, 'semantic' as source, row_number() over (partition by query_id order by distance, id) as rank from found
  union all select query_id, id, 1.0, 'dsl', row_number() over (partition by query_id order by mtime desc, id desc) from met where bare
  union all select query_id, id, 0.5, 'filename', row_number() over (partition by query_id order by mtime desc, id desc) from met where not bare and query_id not in (select query_id from found) and contains(lower(filename), lower(text)))
select * from ranked where rank <= 40""".replace("{distance}", _DISTANCE))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, links = V.tags(spark, sf_dir)
    stored = V.vectors(spark, sf_dir)
    words = V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.split("p_name", " ")[0].alias("word"))
    asked = stored.where("image_id % 20 = 0").withColumn("part", F.col("image_id") % F.lit(words.count()) + 1).join(words, "part")
    text = F.expr("concat(case when image_id % 40 = 20 then '' when image_id % 60 = 0 then word else 'some' end, ' #', word, ' size:>=', 10 + image_id % 7, 'b')")
    searches = asked.select(F.col("image_id").alias("query_id"), text.alias("query"), F.when(F.col("image_id") % 60 != 0, F.col("embedding")).alias("vector"))
    found = vectors.hybrid_searches(V.tagged_assets(spark, sf_dir), links, table, stored, searches)
    return found.withColumn("score", F.round("score", 6))


# --- faces ---------------------------------------------------------------------------

_FACE_PAIRS = lambda t: f"units as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings), pairs as (select a.id as a, b.id as b from units a join units b on a.id < b.id where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {t})"


_CLUSTERS = lambda t: f"with recursive {_FACE_PAIRS(t)}, both_ways as (select a, b from pairs union all select b, a from pairs), reach(id, other) as (select vec_id, vec_id from embeddings union select id, b from reach join both_ways on other = a), named as (select id, min(other) as cluster_id from reach group by id) select cluster_id, count(*) as face_count, arg_min(id % 200, id) as sample_image_id, arg_min('old ' || label, id) filter (label % 2 = 0) as label from named join embeddings on id = vec_id group by cluster_id"


@query(_CLUSTERS(0.42))
def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _face_clusters(spark, sf_dir, 0.42)


@query(_CLUSTERS(faces.THRESHOLD))
def face_clusters_by_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _face_clusters(spark, sf_dir, faces.THRESHOLD)


def _face_clusters(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    found, stored = V.faces(spark, sf_dir)
    prior = found.select(F.col("cluster_id").alias("id")).distinct().where("id % 2 = 0").select("id", F.concat(F.lit("old "), F.col("id")).alias("label"))
    _, clusters = faces.cluster_faces(found, stored, threshold, prior)
    return clusters.select(F.col("id").alias("cluster_id"), "face_count", "sample_image_id", "label")


@query("select label::bigint as cluster_id, count(distinct vec_id % 200) as images from embeddings where (vec_id % 200) % 13 != 0 group by label")
def images_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = V.faces(spark, sf_dir)
    assets = found.select(F.col("image_id").alias("id")).distinct().withColumn("deleted_at", F.when(F.col("id") % 13 == 0, F.lit(1)))
    return faces.images_per_cluster(assets, found)


# --- events ---------------------------------------------------------------------------


@query("""with recursive changes as (select user_id % 10 as root_id, epoch_us(ts) as fired_at from events where event_type in ('click', 'view', 'purchase')),
fired(root_id, fired_at) as (select root_id, min(fired_at) from changes group by root_id union all select f.root_id, min(c.fired_at) from fired f join changes c on c.root_id = f.root_id and c.fired_at >= f.fired_at + 60000000 group by f.root_id)
select root_id, fired_at from fired""")
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = events.debounce_batch(events.watched(V.file_events(spark, sf_dir)), 60.0)
    return fired.select("root_id", F.unix_micros("ts").alias("fired_at"))


@query(f"with {V.ORDERS} select id, rel_path, substr(sha1(chr(root_id::int)::blob || '\\x00\\x00\\x00\\x00\\x00\\x00\\x00|'::blob || rel_path::blob), 1, 16) as key from assets_ord")
def thumb_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.orders(spark, sf_dir).select("id", "rel_path", E.thumb_key(F.col("root_id"), F.col("rel_path")).alias("key"))


