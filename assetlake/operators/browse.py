"""Browsing a catalog: predicates, order, pages, lookups and smart albums."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import boxes
from .numbering import greatest, numbered

DEFAULT_PAGE, LARGEST_PAGE = 200, 500
SORT_KEYS = ("taken_at", "filename", "size_bytes", "mtime")


@dataclass(frozen=True)
class BrowseParams:
    """What a browse query asks for; an absent or empty part filters nothing."""

    root_ids: tuple[int, ...] = ()
    formats: tuple[str, ...] = ()
    text: str = ""
    size_min: int | None = None
    size_max: int | None = None
    taken_from: int | None = None
    taken_to: int | None = None
    has_gps: bool | None = None
    include_deleted: bool = False
    sort: str = "mtime"
    direction: str = "desc"
    offset: int = 0
    limit: int = DEFAULT_PAGE


def predicate(p: BrowseParams) -> Column:
    """All conditions of ``p`` as one expression that reaches the scan."""
    conditions = [F.lit(True)]
    if not p.include_deleted:
        conditions.append(E.live())
    if p.root_ids:
        conditions.append(F.col("root_id").isin(*p.root_ids))
    if p.formats:
        conditions.append(F.col("extension").isin(*(f.lstrip(".").lower() for f in p.formats)))
    if p.text.strip():
        conditions.append(E.contains_literal(F.col("filename"), p.text))
    if p.size_min is not None:
        conditions.append(F.col("size_bytes") >= max(0, p.size_min))
    if p.size_max is not None:
        conditions.append(F.col("size_bytes") <= max(0, p.size_max))
    if p.taken_from is not None:
        conditions.append(E.shown_at() >= p.taken_from)
    if p.taken_to is not None:
        conditions.append(E.shown_at() <= p.taken_to)
    if p.has_gps is not None:
        located = F.col("gps_lat").isNotNull() & F.col("gps_lng").isNotNull()
        conditions.append(located if p.has_gps else ~located)
    return reduce(lambda a, b: a & b, conditions)


def ordering(p: BrowseParams) -> list[Column]:
    """Sort key and id, both in the asked direction; any direction but "asc" is falling, any unknown key is mtime."""
    key = {"taken_at": E.shown_at(), "filename": E.ascii_lower(F.col("filename")), "size_bytes": F.col("size_bytes")}.get(p.sort, F.col("mtime"))
    return [key.asc(), F.col("id").asc()] if p.direction == "asc" else [key.desc(), F.col("id").desc()]


def browse(assets: DataFrame, p: BrowseParams, roots: DataFrame | None = None) -> DataFrame:
    """One page of assets; with ``roots`` (id, path) also each asset's full path."""
    page = assets.where(predicate(p)).orderBy(*ordering(p)).offset(max(0, p.offset)).limit(min(max(1, p.limit), LARGEST_PAGE))
    return page if roots is None else with_full_path(page, roots)


def with_full_path(assets: DataFrame, roots: DataFrame) -> DataFrame:
    """Assets of known roots with ``full_path``."""
    named = roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    return assets.join(named, "root_id").withColumn("full_path", F.concat_ws("/", F.rtrim(F.col("root_path"), F.lit("/")), "rel_path")).drop("root_path")


def page_total(assets: DataFrame, p: BrowseParams) -> DataFrame:
    """One row: the assets that all pages of ``p`` hold."""
    return assets.where(predicate(p)).agg(F.count(F.lit(1)).alias("total"))


def by_id(assets: DataFrame, asset_id: int) -> DataFrame:
    """The asset, deleted or not."""
    return assets.where(F.col("id") == asset_id)


def by_ids(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Live assets of ``ids`` (pos, id) with the least position of each."""
    wanted = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    return assets.where(E.live()).join(wanted, "id")


def union_pages(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both pages; of an id in both the first page's row stays."""
    return first.unionByName(second.join(first.select("id"), "id", "left_anti").select(first.columns))


def clean_ids(ids: Column) -> Column:
    """Positive ids, ascending, each once."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x > 0)))


# --- smart albums ---------------------------------------------------------------

def save_albums(albums: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(albums with the valid rows of ``new`` (name, filter_json, icon, sort_order), rejected rows with a reason)."""
    reason = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "blank name").when(F.try_parse_json("filter_json").isNull(), "invalid filter")
    judged = new.withColumn("reason", reason)
    valid = judged.where("reason is null").select(F.trim("name").alias("name"), "filter_json", "icon", F.coalesce("sort_order", F.lit(0)).cast("long").alias("sort_order"), F.lit(now).cast("long").alias("created_at"))
    rows = numbered(valid, ["name", "filter_json"], greatest(albums)).select("id", "name", "filter_json", "icon", "sort_order", "created_at")
    return albums.unionByName(rows), judged.where("reason is not null")


def list_albums(albums: DataFrame) -> DataFrame:
    return albums.orderBy("sort_order", "id")


def drop_albums(albums: DataFrame, ids: DataFrame) -> DataFrame:
    return albums.join(ids.select("id"), "id", "left_anti")


def album_members(assets: DataFrame, albums: DataFrame) -> DataFrame:
    """(album_id, id) for every asset that an album's filter takes (see ``boxes``)."""
    return boxes.members(assets, albums)


def album_counts(assets: DataFrame, albums: DataFrame) -> DataFrame:
    """Members of each album, 0 included."""
    return albums.select(F.col("id").alias("album_id"), "name").join(boxes.counts(assets, albums), "album_id", "left").select("album_id", "name", F.coalesce("members", F.lit(0)).alias("members"))


def album_page(assets: DataFrame, albums: DataFrame, album_id: int, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page of an album, newest first; where to begin and how much to take are the caller's, not the album's."""
    members = album_members(assets, albums.where(F.col("id") == album_id)).select("id")
    page = assets.join(members, "id", "left_semi").orderBy(*ordering(BrowseParams()))
    return page.offset(max(0, offset)).limit(min(max(1, limit), LARGEST_PAGE)).select(assets.columns)
