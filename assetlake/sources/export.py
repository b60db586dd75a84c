"""Writing reports and snapshots of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E


def duplicates_report(groups: DataFrame, items: DataFrame, assets: DataFrame, roots: DataFrame) -> DataFrame:
    """All groups' items as the rows of the report, 14 columns of text."""
    paths = roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    named = groups.select(F.col("id").alias("group_id"), "method", "threshold", F.col("status").alias("group_status"), "keep_image_id")
    rows = items.join(named, "group_id").join(assets, items["image_id"] == assets["id"]).join(paths, "root_id")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        text(F.col("group_id")).alias("group_id"), "method", text(F.col("threshold")).alias("threshold"), F.col("group_status").alias("status"), text(F.col("image_id")).alias("image_id"),
        F.coalesce(F.format_string("%.4f", "similarity"), F.lit("")).alias("similarity"), F.coalesce(F.col("image_id") == F.col("keep_image_id"), F.lit(False)).cast("int").cast("string").alias("kept"),
        F.concat_ws("/", "root_path", "rel_path").alias("path"), "filename", text(F.col("size_bytes")).alias("size_bytes"), text(F.col("width")).alias("width"), text(F.col("height")).alias("height"),
        text(F.col("content_hash")).alias("content_hash"), F.coalesce(E.unsigned(F.col("dhash")), F.lit("")).alias("dhash"),
    )


def export_duplicates_csv(report: DataFrame, path: str) -> None:
    """The report as CSV files that begin with a byte-order mark; quoted only where it must be."""
    marked = report.withColumnRenamed("group_id", "﻿group_id")
    marked.write.csv(path, header=True, quote='"', escape='"', emptyValue="", mode="overwrite")


_MANIFEST = "table string, kind string, rows long, files long, digest string"


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): a sum of the rows' hashes, whatever their order."""
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).cast("string").alias("digest"))


def folder_table(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, bytes, sha256, content) of all files below a folder, thumbnails or models."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    root = "/" + path.removeprefix("file:").strip("/")
    return files.select(F.substring(bare("path"), len(root) + 2, 1_000_000).alias("rel_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def export_snapshot(tables: dict[str, DataFrame], path: str, folders: dict[str, str] | None = None) -> DataFrame:
    """Write every table as Parquet under ``path``, on request ``folders`` (thumbnails, models) as tables of files, and a manifest beside.

    Returns the manifest (table, kind, rows, files, digest).
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    held = [(name, "table", df) for name, df in sorted(tables.items())] + [(name, "folder", folder_table(spark, place)) for name, place in sorted((folders or {}).items())]
    for name, kind, df in held:
        df.write.parquet(f"{path}/{name}", mode="overwrite")
        back = spark.read.parquet(f"{path}/{name}")
        facts = table_digest(back).first()
        rows.append((name, kind, facts["rows"], len(back.inputFiles()), facts["digest"]))
    manifest = spark.createDataFrame(rows, _MANIFEST)
    manifest.coalesce(1).write.json(f"{path}/manifest", mode="overwrite")
    return manifest


def restore_snapshot(spark: SparkSession, path: str, staging: str) -> dict[str, DataFrame]:
    """Copy a snapshot into ``staging`` and return its tables, after checking their rows and digests against the manifest."""
    out = {}
    for r in spark.read.schema(_MANIFEST).json(f"{path}/manifest").collect():
        df = spark.read.parquet(f"{path}/{r['table']}")
        facts = table_digest(df).first()
        if (facts["rows"], facts["digest"]) != (r["rows"], r["digest"]):
            raise ValueError(f"{r['table']} is not the table of {r['rows']} rows that the manifest has")
        df.write.parquet(f"{staging}/{r['table']}", mode="error")
        out[r["table"]] = spark.read.parquet(f"{staging}/{r['table']}")
    return out
