"""Consecutive numbers for rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def numbered(rows: DataFrame, order: list[str | Column], after: int = 0, name: str = "id") -> DataFrame:
    """``rows`` with ``name``: numbers from ``after`` + 1 on, ascending by ``order``, which tells all rows apart.

    Rows are dealt out by ranges and written down with their range, as Spark may
    draw the ranges anew each time that it computes them. They are then numbered
    within the ranges, whose sizes give each its first number.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, n, before = (f"_{name}_{x}" for x in ("part", "n", "before"))
    placed = written(rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    local = placed.withColumn(n, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    ranges = placed.groupBy(part).count()  # one row for each range
    starts = ranges.select(part, F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return local.join(F.broadcast(starts), part).withColumn(name, F.lit(after) + F.col(before) + F.col(n)).drop(part, n, before)


def greatest(table: DataFrame, column: str = "id") -> int:
    """The greatest number of a table; 0 if it is empty."""
    return table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
