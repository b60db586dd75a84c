"""Roll-ups of a catalog by time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E


def _dated(assets: DataFrame, tz: str) -> DataFrame:
    at = E.local_time(E.shown_at(), tz)
    return assets.where(E.live()).select("*", E.shown_at().alias("shown_at"), F.year(at).alias("year"), F.month(at).alias("month"))


def timeline(assets: DataFrame, tz: str = "UTC", limit: int = 120) -> DataFrame:
    """Months in local time, newest first: number of live assets and their first and last time; 1 to 240 months."""
    months = _dated(assets, tz).groupBy("year", "month").agg(F.count(F.lit(1)).alias("assets"), F.min("shown_at").alias("first_at"), F.max("shown_at").alias("last_at"))
    return months.orderBy(F.desc("year"), F.desc("month")).limit(min(max(limit, 1), 240))


def timeline_samples(assets: DataFrame, tz: str = "UTC", per_month: int = 50) -> DataFrame:
    """The newest assets of every month, with their rank; Spark keeps only so many per task before it shuffles."""
    newest = Window.partitionBy("year", "month").orderBy(F.desc("shown_at"), F.desc("id"))
    return _dated(assets, tz).select("id", "year", "month", "shown_at").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= per_month)


def map_points(assets: DataFrame, limit: int = 2000) -> DataFrame:
    """The newest live assets with a place, 1 to 5000."""
    located = assets.where(E.live() & F.col("gps_lat").isNotNull() & F.col("gps_lng").isNotNull())
    return located.select("id", "gps_lat", "gps_lng", E.shown_at().alias("shown_at")).orderBy(F.desc("shown_at"), F.desc("id")).limit(min(max(limit, 1), 5000))


def map_bounds(points: DataFrame) -> DataFrame:
    """One row with the bounding box of ``points`` (nulls for none)."""
    return points.agg(*(f(c).alias(f"{n}_{c[4:]}") for c in ("gps_lat", "gps_lng") for n, f in (("min", F.min), ("max", F.max))))


def selection_stats(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Number and total size of the chosen assets."""
    chosen = assets.join(ids.select("id").distinct(), "id", "left_semi")
    return chosen.agg(F.count(F.lit(1)).alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


# --- roll-ups that are kept, and follow changes --------------------------------------


def changed_counts(kept: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts ``kept`` (keys, n) less the rows of ``before`` and with those of ``after``: of the changed rows, as they were and as they are. What falls to 0 goes."""
    signed = lambda df, sign: df.select(*keys, F.lit(sign).cast("long").alias("n"))
    change = signed(before, -1).unionByName(signed(after, 1)).groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")
    return kept.select(*keys, "n").unionByName(change).groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")


_MOMENT, _MONTH = ["year", "month", "shown_at"], ["year", "month"]


def kept_timeline(assets: DataFrame, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(months, moments) to be kept: what ``timeline`` counts, for all months, and how many live assets each moment has, from which a lost extreme is found again."""
    moments = _dated(assets, tz).groupBy(*_MOMENT).agg(F.count(F.lit(1)).alias("n"))
    return _months(moments), moments


def _months(moments: DataFrame) -> DataFrame:
    return moments.groupBy(*_MONTH).agg(F.sum("n").alias("assets"), F.min("shown_at").alias("first_at"), F.max("shown_at").alias("last_at"))


def updated_timeline(months: DataFrame, moments: DataFrame, before: DataFrame, after: DataFrame, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(months, moments) after a change set; months that it does not touch are taken over as they are."""
    old, new = _dated(before, tz).select(*_MOMENT), _dated(after, tz).select(*_MOMENT)
    touched = old.unionByName(new).select(*_MONTH).distinct()
    now = changed_counts(moments, old, new, _MOMENT)
    again = _months(now.join(touched, _MONTH, "left_semi"))
    return months.join(touched, _MONTH, "left_anti").unionByName(again), now


def newest_months(months: DataFrame, limit: int = 120) -> DataFrame:
    """``timeline`` from the kept months."""
    return months.orderBy(F.desc("year"), F.desc("month")).limit(min(max(limit, 1), 240))
