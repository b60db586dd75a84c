"""Resolving duplicate groups: which member stays, and deletions that can be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as E

UNDO_SECONDS = 30 * 86_400
RULES = ("largest", "newest", "biggest_file", "shortest_name")
LARGEST_PAGE = 500
#: Items of a row of an undo entry, on average.
ITEMS_OF_A_ROW = 10_000




def choose_keep(items: DataFrame, assets: DataFrame, rule: str) -> DataFrame:
    """(group_id, keep_id): the live member that ``rule`` puts first.

    The survivor is found by an aggregate over the rule's keys as one ordered
    struct, so the members of a large group are combined before they shuffle.
    """
    live = items.join(assets.where(E.live()), items["image_id"] == assets["id"])
    area, name = E.pixels(F.col("width"), F.col("height")), F.char_length("filename")
    keys = {
        "largest": [area, F.col("size_bytes"), F.col("mtime"), F.col("id")],
        "newest": [F.col("mtime"), area, F.col("size_bytes"), F.col("id")],
        "biggest_file": [F.col("size_bytes"), area, F.col("mtime"), F.col("id")],
        "shortest_name": [-name, area, F.col("size_bytes"), F.col("mtime"), -F.col("id")],
    }
    if rule not in keys:
        raise ValueError(f"no such rule: {rule}")
    return live.groupBy("group_id").agg(F.max_by("id", F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys[rule])))).alias("keep_id"))


def suggest_keep(items: DataFrame, assets: DataFrame) -> DataFrame:
    """(group_id, keep_id) by one weighted score of area, size and time; then similarity, then the least id."""
    live = items.join(assets.where(E.live()), items["image_id"] == assets["id"])
    n = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
    score = (E.pixels(F.col("width"), F.col("height")) * F.lit(1_000_000_000).cast("decimal(10,0)") + n("size_bytes") * F.lit(1000).cast("decimal(4,0)") + n("mtime")).cast("decimal(38,0)")
    ranked = F.row_number().over(Window.partitionBy("group_id").orderBy(score.desc(), F.desc_nulls_last("similarity"), F.asc("id")))
    return live.withColumn("rank", ranked).where("rank = 1").select("group_id", F.col("id").alias("keep_id"))


def groups_page(groups: DataFrame, items: DataFrame, method: str = "", status: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    """The newest groups with their number of items; an empty method or status takes all."""
    chosen = groups
    for column, wanted in (("method", method), ("status", status)):
        chosen = chosen.where(F.col(column) == wanted) if wanted else chosen
    page = chosen.orderBy(F.desc("id")).offset(max(0, offset)).limit(min(max(limit, 1), LARGEST_PAGE))
    n = items.groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return page.join(n, "id", "left").withColumn("item_count", F.coalesce("n", F.lit(0))).drop("n")


def group_ids(groups: DataFrame) -> DataFrame:
    return groups.select("id").orderBy(F.desc("id"))


def open_groups(groups: DataFrame) -> DataFrame:
    """One row: the number of open groups."""
    return groups.where("status = 'open'").agg(F.count(F.lit(1)).alias("open_groups"))


def items_of_groups(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Items with their assets and their rank in the group: by similarity, then id."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc_nulls_last("similarity"), F.asc("image_id")))
    return items.join(assets, items["image_id"] == assets["id"]).withColumn("rank", rank)


def open_group_of(groups: DataFrame, items: DataFrame, image_id: int, method: str) -> DataFrame:
    """The least open group of a method that holds the image."""
    held = items.where(F.col("image_id") == image_id).select(F.col("group_id").alias("id"))
    return groups.where((F.col("status") == "open") & (F.col("method") == method)).join(held, "id", "left_semi").orderBy("id").limit(1)


def plan_batch(groups: DataFrame, items: DataFrame, assets: DataFrame, method: str, rule: str, action: str = "trash") -> tuple[DataFrame, DataFrame]:
    """(plan, failures) for all open groups of one method.

    plan: (group_id, action, keep_id, trash_ids). Groups of fewer than two live
    members fail. ``keep_all`` and ``dismiss`` only change statuses; for
    ``trash`` the method must be a single one and the rule known.
    """
    if action not in ("trash", "keep_all", "dismiss"):
        raise ValueError(f"no such action: {action}")
    if action == "trash" and method not in schemas.METHODS:
        raise ValueError("trashing takes one method")
    chosen = groups.where((F.col("status") == "open") & (F.lit(method == "all") | (F.col("method") == method))).select(F.col("id").alias("group_id"))
    own = items.join(chosen, "group_id", "left_semi")
    if action != "trash":
        plan = chosen.select("group_id", F.lit(action).alias("action"), F.lit(None).cast("long").alias("keep_id"), F.array().cast("array<long>").alias("trash_ids"))
        return plan, chosen.select("group_id", F.lit("").alias("reason")).where("false")
    live = own.join(assets.where(E.live()).select(F.col("id").alias("image_id")), "image_id", "left_semi")
    members = live.groupBy("group_id").agg(F.array_sort(F.collect_set("image_id")).alias("ids"))
    judged = chosen.join(members, "group_id", "left").join(choose_keep(own, assets, rule), "group_id", "left")
    few = F.coalesce(F.size("ids"), F.lit(0)) < 2
    plan = judged.where(~few).select("group_id", F.lit("trash").alias("action"), "keep_id", F.filter("ids", lambda x: x != F.col("keep_id")).alias("trash_ids"))
    return plan, judged.where(few).select("group_id", F.lit("fewer than two live members").alias("reason"))


def plan_group(group_id: int, items: DataFrame, keep_ids: list[int]) -> DataFrame:
    """The plan of one group: all its items but ``keep_ids`` go, the first of these is recorded."""
    own = items.where(F.col("group_id") == group_id)
    gone = F.array_sort(F.collect_set(F.when(~F.col("image_id").isin(*keep_ids), F.col("image_id"))))
    return own.groupBy("group_id").agg(gone.alias("trash_ids")).select("group_id", F.lit("trash").alias("action"), F.lit(keep_ids[0]).cast("long").alias("keep_id"), "trash_ids")


def apply_plan(plan: DataFrame, outcome: DataFrame, groups: DataFrame, items: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, items, failures) after ``plan``, given ``outcome`` (id, ok) of each removal.

    A group is resolved only if all its removals succeeded; else it stays open
    without the items that are gone.
    """
    wanted = plan.select("group_id", F.explode_outer("trash_ids").alias("id"))
    ok = outcome.groupBy("id").agg(F.bool_and("ok").alias("ok"))
    result = wanted.join(ok, "id", "left").withColumn("ok", F.when(F.col("id").isNull(), True).otherwise(F.coalesce("ok", F.lit(False))))
    verdict = result.groupBy("group_id").agg(F.bool_and("ok").alias("all_ok"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))
    done = plan.join(verdict, "group_id").select(F.col("group_id").alias("id"), "action", "keep_id", "all_ok")
    joined = groups.join(done.withColumnRenamed("keep_id", "new_keep"), "id", "left")
    closes = F.coalesce("all_ok", F.lit(False))
    value = {
        "status": F.when(closes, F.when(F.col("action") == "dismiss", "dismissed").otherwise("resolved")).otherwise(F.col("status")),
        "keep_image_id": F.when(closes, F.coalesce("new_keep", "keep_image_id")).otherwise(F.col("keep_image_id")),
        "resolved_at": F.when(closes, F.lit(now)).otherwise(F.col("resolved_at")),
    }
    new_groups = joined.select(*(value.get(c, F.col(c)).alias(c) for c in groups.columns))
    partly = result.join(verdict.where("not all_ok"), "group_id", "left_semi").where("ok and id is not null").select("group_id", F.col("id").alias("image_id"))
    return new_groups, remove_items(items, partly), verdict.where("not all_ok").select("group_id", "failed")


def remove_items(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Items without the pairs (group_id, image_id) of ``gone``; unknown ones don't matter."""
    return items.join(gone, ["group_id", "image_id"], "left_anti").select(items.columns)


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with those of ``new`` whose pair is not there yet."""
    fresh = new.dropDuplicates(["group_id", "image_id"]).join(items, ["group_id", "image_id"], "left_anti")
    return items.unionByName(fresh.select(items.columns))


def merge_groups(groups: DataFrame, items: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """(groups, items) with the source's items in the target (its own win) and the source gone."""
    moved = items.where(F.col("group_id") == source).withColumn("group_id", F.lit(target).cast("long"))
    return groups.where(F.col("id") != source), add_items(items.where(F.col("group_id") != source), moved)


def soft_delete(assets: DataFrame, roots: DataFrame, ids: DataFrame, now: int, permanent: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, undo rows, failures): the live assets of ``ids`` are deleted as of ``now``; unknown ids fail.

    One undo entry covers all that were deleted, in a row for each ``ITEMS_OF_A_ROW`` items or so, which
    share what else an entry has; without any there is none.
    """
    asked = ids.select("id").where("id > 0").distinct()
    paths = roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    found = assets.where(E.live()).join(asked, "id", "left_semi").join(paths, "root_id", "left")
    item = F.struct(F.col("id").alias("imageId"), F.concat_ws("/", "root_path", "rel_path").alias("originalPath"), F.lit(permanent).alias("permanent"))
    payload = F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items")))
    parts = found.agg(F.ceil(F.count(F.lit(1)) / ITEMS_OF_A_ROW).alias("parts"))  # one row
    undo = found.crossJoin(F.broadcast(parts)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).groupBy("part").agg(payload.alias("payload_json"))
    undo = undo.select(F.lit("trash").alias("action"), "payload_json", F.lit(now + UNDO_SECONDS).cast("long").alias("can_undo_until"), F.lit(None).cast("long").alias("undone_at"), F.lit(now).cast("long").alias("created_at"))
    mark = asked.withColumn("gone", F.lit(True))
    deleted = assets.join(mark, "id", "left").withColumn("deleted_at", F.when(F.col("gone") & E.live(), F.lit(now)).otherwise(F.col("deleted_at"))).select(assets.columns)
    failures = asked.join(assets.where(E.live()), "id", "left_anti").select("id", F.lit("unknown or deleted").alias("reason"))
    return deleted, undo, failures


def undo_items(undo_log: DataFrame) -> DataFrame:
    """(undo_id, imageId, originalPath, permanent) of all payloads; a missing flag is false."""
    items = undo_log.select(F.col("id").alias("undo_id"), F.explode(F.from_json("payload_json", schemas.UNDO_ITEMS)["items"]).alias("item"))
    return items.select("undo_id", "item.imageId", "item.originalPath", F.coalesce("item.permanent", F.lit(False)).alias("permanent"))


def undo(assets: DataFrame, undo_log: DataFrame, undo_id: int, now: int, enforce_window: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assets, undo_log) with the deletions of one entry taken back; what was removed for good stays deleted."""
    entry = undo_log.where(F.col("id") == undo_id).select("action", "undone_at", "can_undo_until").first()
    if entry is None:
        raise ValueError("no such undo entry")
    if entry["undone_at"] is not None:
        raise ValueError("already undone")
    if entry["action"] != "trash":
        raise ValueError("only deletions can be undone")
    if enforce_window and entry["can_undo_until"] < now:
        raise ValueError("too late to undo")
    back = undo_items(undo_log.where(F.col("id") == undo_id)).where("not permanent").select(F.col("imageId").alias("id")).distinct().withColumn("back", F.lit(True))
    restored = assets.join(back, "id", "left").withColumn("deleted_at", F.when(F.col("back"), F.lit(None).cast("long")).otherwise(F.col("deleted_at"))).select(assets.columns)
    return restored, undo_log.withColumn("undone_at", F.when(F.col("id") == undo_id, F.lit(now)).otherwise(F.col("undone_at")))


def undo_history(undo_log: DataFrame, limit: int = 50) -> DataFrame:
    """Entries that can still be undone, newest first, with their number of items; an entry's rows are one, without the payload."""
    n = F.coalesce(F.size(F.from_json("payload_json", schemas.UNDO_ITEMS)["items"]), F.lit(0))
    entries = undo_log.where("undone_at is null").groupBy(*_entry(undo_log)).agg(F.sum(n).alias("item_count"))
    return entries.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(limit, 1), 200))


def expired_undo(undo_log: DataFrame, now: int) -> DataFrame:
    """Entries whose window is over, without their payloads."""
    return undo_log.where((F.col("can_undo_until") < now) & F.col("undone_at").isNull()).select(*_entry(undo_log)).distinct()


def _entry(undo_log: DataFrame) -> list[str]:
    """The columns that all rows of an entry share."""
    return [c for c in undo_log.columns if c != "payload_json"]
