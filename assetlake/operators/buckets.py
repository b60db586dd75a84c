"""Catalog versions in buckets by (root_id, rel_path): reconciled with a listing without moving either.

Catalog and listing are written as tables whose rows lie in buckets of their
key, sorted. Their full outer join then needs no exchange: each task reads one
bucket of both. The next version comes from that one pass; only rows that
are new move, as they are numbered over ranges of the key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .graph import fresh_path
from .numbering import greatest, numbered
from .reconcile import KEY

BUCKETS = 16


def write_buckets(df: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a table of its own in buckets by KEY, in the shared folder, one file each; read back.

    Tables that are to be joined need the same number of buckets.
    """
    spark: SparkSession = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *KEY).write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
    dealt.option("path", fresh_path(spark, table)).saveAsTable(table)
    return spark.table(table)


def next_version(prev: DataFrame, listing: DataFrame, now: int, complete: bool = True) -> DataFrame:
    """The catalog after ``listing``: what ``reconcile.classify`` and ``apply_changes`` give, in one join by KEY."""
    new = listing.dropDuplicates(KEY)
    brought = [c for c in schemas.LISTED[2:] + schemas.METADATA if c in new.columns]
    renamed = new.select(*(F.col(c).alias(f"key_{c}") for c in KEY), *(F.col(c).alias(f"new_{c}") for c in brought), F.lit(True).alias("listed"))
    met = prev.withColumn("known", F.lit(True)).join(renamed, (F.col("root_id") == F.col("key_root_id")) & (F.col("rel_path") == F.col("key_rel_path")), "full_outer")
    gone, same = F.col("listed").isNull(), F.col("size_bytes").eqNullSafe(F.col("new_size_bytes")) & F.col("mtime").eqNullSafe(F.col("new_mtime"))
    removed = gone & F.col("deleted_at").isNull() & F.lit(complete)
    renewed = ~gone & (F.col("deleted_at").isNotNull() | ~same)

    def value(c: str):
        if c in brought:
            return F.when(renewed, F.col(f"new_{c}")).otherwise(F.col(c))
        if c in schemas.FRESH:
            return F.when(renewed, F.lit(schemas.FRESH[c])).otherwise(F.col(c))
        if c == "indexed_at":
            return F.when(renewed, F.lit(now)).otherwise(F.col(c))
        if c == "deleted_at":
            return F.when(removed, F.lit(now)).when(renewed, F.lit(None)).otherwise(F.col(c))
        return F.col(c)

    kept = met.where("known").select(*(value(c).cast(prev.schema[c].dataType).alias(c) for c in prev.columns))
    fresh = met.where("known is null").select(*(F.col(f"key_{c}").alias(c) for c in KEY), *(F.col(f"new_{c}").alias(c) for c in brought))
    fresh = numbered(fresh, KEY, greatest(prev))
    given = {c: F.col(c) for c in fresh.columns} | {c: F.lit(v) for c, v in schemas.FRESH.items()} | {"indexed_at": F.lit(now)}
    return kept.unionByName(fresh.select(*(given.get(c, F.lit(None)).cast(prev.schema[c].dataType).alias(c) for c in prev.columns)))
