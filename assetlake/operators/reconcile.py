"""Reconciling a catalog with a new listing, as functions from state and changes to a new state.

Every operator takes the whole previous table and returns the whole next one, to
be written as a new snapshot; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as E
from .graph import written
from .numbering import greatest, numbered

UNDO_SECONDS = 30 * 86_400
KEY = ["root_id", "rel_path"]


def classify(prev: DataFrame, listing: DataFrame, complete: bool = True) -> DataFrame:
    """Every path of catalog and listing with its change.

    added: not in the catalog; unchanged: live, with the same size and time;
    restored: deleted before and listed again; updated: any other listed one;
    removed: live, not listed, and the listing is complete; kept: the rest.
    ``listing`` has the columns of ``schemas.LISTED`` and may have more.
    """
    old = prev.select(*KEY, F.col("id"), F.col("size_bytes").alias("old_size"), F.col("mtime").alias("old_mtime"), "deleted_at", F.lit(True).alias("known"))
    new = listing.dropDuplicates(KEY).withColumn("listed", F.lit(True))
    both = old.join(new, KEY, "full_outer")
    same = F.col("size_bytes").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    change = (
        F.when(F.col("listed").isNull(), F.when(F.col("deleted_at").isNull() & F.lit(complete), "removed").otherwise("kept"))
        .when(F.col("known").isNull(), "added")
        .when(F.col("deleted_at").isNotNull(), "restored")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return both.withColumn("change", change).drop("known", "listed", "old_size", "old_mtime", "deleted_at")


def apply_changes(prev: DataFrame, classified: DataFrame, now: int) -> DataFrame:
    """The catalog after ``classified``.

    Added rows get the next ids by (root_id, rel_path) and fresh values; updated
    and restored ones take the listed values, lose all that was derived from the
    old content and are live; removed ones are deleted as of ``now``.
    """
    listed = [c for c in schemas.LISTED[2:] + schemas.METADATA if c in classified.columns]
    classified = written(classified.where(F.col("change").isin("added", "updated", "restored", "removed")))  # read for both parts of the result
    changed = classified.where(F.col("change").isin("updated", "restored", "removed")).select("id", "change", *(F.col(c).alias(f"new_{c}") for c in listed))
    joined = prev.join(changed, "id", "left")
    renewed = F.col("change").isin("updated", "restored")

    def value(c: str):
        if c in listed:
            return F.when(renewed, F.col(f"new_{c}")).otherwise(F.col(c))
        if c in schemas.FRESH:
            return F.when(renewed, F.lit(schemas.FRESH[c])).otherwise(F.col(c))
        if c == "indexed_at":
            return F.when(renewed, F.lit(now)).otherwise(F.col(c))
        if c == "deleted_at":
            return F.when(F.col("change") == "removed", F.lit(now)).when(renewed, F.lit(None)).otherwise(F.col(c))
        return F.col(c)

    kept = joined.select(*(value(c).cast(prev.schema[c].dataType).alias(c) for c in prev.columns))
    fresh = numbered(classified.where("change = 'added'").drop("id"), KEY, greatest(prev))
    given = {c: F.col(c) for c in fresh.columns} | {c: F.lit(v) for c, v in schemas.FRESH.items()} | {"indexed_at": F.lit(now)}
    added = fresh.select(*(given.get(c, F.lit(None)).cast(prev.schema[c].dataType).alias(c) for c in prev.columns))
    return kept.unionByName(added)


def reconcile_roots(assets: DataFrame, listing: DataFrame, roots: DataFrame, now: int) -> DataFrame:
    """The catalog after only the ``roots`` (root_id) have been listed anew; what a fired root starts. Other roots stay as they are."""
    chosen = roots.select("root_id").distinct()
    of = lambda df, how: df.join(chosen, "root_id", how).select(df.columns)
    changes = classify(of(assets, "left_semi"), of(listing, "left_semi"))
    return apply_changes(assets, changes, now)


def scan_summary(classified: DataFrame) -> DataFrame:
    """Numbers of added, updated (restored included) and removed paths and of all listed ones, per root."""
    is_ = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    return classified.groupBy("root_id").agg(
        is_("added").alias("added"), is_("updated", "restored").alias("updated"), is_("removed").alias("removed"), is_("added", "updated", "restored", "unchanged").alias("total")
    )


def backfill_metadata(prev: DataFrame, meta: DataFrame, now: int) -> DataFrame:
    """Fill missing metadata of ``prev`` from ``meta`` (id and metadata columns); the rows it names count as indexed now."""
    named = [c for c in schemas.METADATA if c in meta.columns]
    found = meta.dropDuplicates(["id"]).select("id", *(F.col(c).alias(f"new_{c}") for c in named), F.lit(True).alias("named"))
    joined = prev.join(found, "id", "left")
    value = {c: F.coalesce(F.col(c), F.col(f"new_{c}")) for c in named} | {"indexed_at": F.when(F.col("named"), F.lit(now)).otherwise(F.col("indexed_at"))}
    return joined.select(*(value.get(c, F.col(c)).cast(prev.schema[c].dataType).alias(c) for c in prev.columns))


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The newest scan runs."""
    return runs.orderBy(F.coalesce("started_at", F.lit(0)).desc(), F.desc("id")).limit(n)


def fail_interrupted(runs: DataFrame, now: int) -> DataFrame:
    """Runs that were waiting or running count as failed."""
    open_ = F.col("status").isin("queued", "running")
    return runs.withColumns({"status": F.when(open_, "failed").otherwise(F.col("status")), "finished_at": F.when(open_, F.lit(now)).otherwise(F.col("finished_at"))})


def rename_assets(assets: DataFrame, renames: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, rejects with a reason, undo rows) for ``renames`` (id, new_name); the folder of a path stays.

    Of several renames of an asset the least name is taken; of several assets
    that would get one path, the least id gets it and the others are rejected.
    If ``renames`` has size_bytes and mtime, as read after the rename, they are
    taken over; a renamed asset counts as indexed at ``now``.
    """
    fresh = [c for c in ("size_bytes", "mtime") if c in renames.columns]
    asked = renames.groupBy("id").agg(F.min(F.struct("new_name", *fresh)).alias("asked"))
    asked = asked.select("id", F.trim(F.coalesce("asked.new_name", F.lit(""))).alias("new_name"), *(F.col(f"asked.{c}").alias(f"new_{c}") for c in fresh))
    judged = asked.join(assets.where(E.live()).select("id", "root_id", "rel_path"), "id", "left")
    folder = F.regexp_extract("rel_path", r"^(.*[\\/])?", 1)
    judged = judged.withColumn("new_path", F.concat(folder, "new_name"))
    taken = assets.where(E.live()).select("root_id", F.col("rel_path").alias("new_path"), F.col("id").alias("holder"))
    judged = judged.join(taken, ["root_id", "new_path"], "left")
    reason = (
        F.when(F.col("new_name") == "", "empty name")
        .when(F.col("new_name").isin(".", "..") | F.col("new_name").rlike(r"[\\/]"), "invalid name")
        .when(F.col("rel_path").isNull(), "unknown asset")
        .when(F.col("holder").isNotNull() & (F.col("holder") != F.col("id")), "name is taken")
    )
    judged = judged.withColumn("reason", reason)
    first = judged.where("reason is null").groupBy("root_id", "new_path").agg(F.min("id").alias("first"))
    judged = judged.join(first, ["root_id", "new_path"], "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("id") != F.col("first")), "name is taken").otherwise(F.col("reason")))
    good = judged.where("reason is null")
    joined = assets.join(good.select("id", "new_name", "new_path", *(f"new_{c}" for c in fresh)), "id", "left")
    hit = F.col("new_path").isNotNull()
    value = {
        "rel_path": F.coalesce("new_path", "rel_path"),
        "filename": F.coalesce("new_name", "filename"),
        "extension": F.when(hit, E.ascii_lower(F.regexp_extract("new_name", r"\.([^.]+)$", 1))).otherwise(F.col("extension")),
        "indexed_at": F.when(hit, F.lit(now)).otherwise(F.col("indexed_at")) if "indexed_at" in assets.columns else None,
    } | {c: F.coalesce(f"new_{c}", c) for c in fresh}
    renamed = joined.select(*(value.get(c, F.col(c)).cast(assets.schema[c].dataType).alias(c) for c in assets.columns))
    payload = F.to_json(F.struct(F.col("id").alias("imageId"), F.col("rel_path").alias("from"), F.col("new_path").alias("to")))
    undo = good.select(F.lit("rename").alias("action"), payload.alias("payload_json"), F.lit(now + UNDO_SECONDS).cast("long").alias("can_undo_until"), F.lit(None).cast("long").alias("undone_at"), F.lit(now).cast("long").alias("created_at"))
    return renamed, judged.where("reason is not null").select("id", "new_name", "reason"), undo


def add_roots(roots: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``roots`` with the paths of ``new`` (path, label, type) that it has not."""
    fresh = new.dropDuplicates(["path"]).join(roots.select("path"), "path", "left_anti")
    given = {c: F.col(c) for c in ("id", *fresh.columns)} | {"enabled": F.lit(True), "created_at": F.lit(now)}
    return roots.unionByName(numbered(fresh, ["path"], greatest(roots)).select(*(given.get(c, F.lit(None)).cast(roots.schema[c].dataType).alias(c) for c in roots.columns)))


def patch_roots(roots: DataFrame, patches: DataFrame) -> DataFrame:
    """``roots`` with the columns of ``patches`` (id, ...) that are not null."""
    fields = [c for c in patches.columns if c != "id" and c in roots.columns]
    joined = roots.join(patches.select("id", *(F.col(c).alias(f"new_{c}") for c in fields)), "id", "left")
    return joined.select(*((F.coalesce(f"new_{c}", c) if c in fields else F.col(c)).alias(c) for c in roots.columns))


def list_roots(roots: DataFrame) -> DataFrame:
    return roots.orderBy("created_at", "id")


def remove_roots(tables: dict[str, DataFrame], root_ids: list[int]) -> dict[str, DataFrame]:
    """All tables without the roots, their assets, and what hangs on those (columns image_id or asset ids)."""
    gone = tables["assets"].where(F.col("root_id").isin(*root_ids)).select("id")
    out = {}
    for name, df in tables.items():
        if name == "roots":
            out[name] = df.where(~F.col("id").isin(*root_ids))
        elif name == "assets" or "root_id" in df.columns:
            out[name] = df.where(~F.col("root_id").isin(*root_ids))
        elif "image_id" in df.columns:
            out[name] = df.join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti").select(df.columns)
        else:
            out[name] = df
    return out


def set_status(assets: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """``assets`` with the statuses of ``updates`` (id, status) in ``column``; statuses that it may not have are refused."""
    allowed = schemas.STATUSES[column]
    new = updates.groupBy("id").agg(F.max("status").alias("new_status"))
    checked = F.when(F.col("new_status").isNull() | F.col("new_status").isin(*allowed), F.col("new_status")).otherwise(F.raise_error(F.concat(F.lit(f"{column} cannot be "), F.col("new_status"))))
    return assets.join(new, "id", "left").withColumn(column, F.coalesce(checked, F.col(column))).select(assets.columns)


def mark_pending(assets: DataFrame, column: str, ids: DataFrame | None = None) -> DataFrame:
    """Live assets with a thumbnail are pending again in ``column``: the listed ones, or all that are disabled or failed."""
    ready = E.live() & (F.col("thumb_status") == "ready")
    if ids is None:
        return assets.withColumn(column, F.when(ready & F.col(column).isin("disabled", "failed"), "pending").otherwise(F.col(column)))
    asked = ids.select("id").distinct().withColumn("asked", F.lit(True))
    return assets.join(asked, "id", "left").withColumn(column, F.when(ready & F.col("asked"), "pending").otherwise(F.col(column))).select(assets.columns)
