"""Content-addressed ledgers: keep results by (content digest, version) and work only on what is missing.

A ledger is a Parquet folder with the columns ``digest``, ``version`` and the
results. Rows are only appended, in one write after the work is whole, so a
lost executor or a failed job leaves it as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder for the ledger of a single run."""
    return f"{common.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ledger at ``path``; empty if there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def content_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text."""
    return F.sha2(text.cast("binary"), 256)


def results_by_key(contents: DataFrame, path: str, version: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The ledger's results for each row of ``contents`` (key long, text), after working on what it lacks.

    ``work`` takes (digest, text), one row for each content that ``path`` has
    not under ``version``, and returns the columns of ``schema`` (digest,
    version, results); its rows are appended to the ledger. One row comes back
    for each row of ``contents``: repeated and null keys keep theirs.

    One scan digests the texts; the copies and the known contents are picked out
    on digests alone; a second scan leaves those rows out by an anti join. Its
    small side is broadcast, and no text shuffled, only while its counted rows stay within ``common.BROADCAST_BYTES``.
    """
    spark = contents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    contents = contents.select(F.coalesce("key", F.lit(-(1 << 63))).alias("key"), text.alias("text"), content_digest(text).alias("digest"), F.col("key").isNull().alias("no_key"))
    keys = common.materialize(contents.select("key", "no_key", "digest"), "digests")
    known = read(spark, path, schema).where(F.col("version") == version).select("digest", F.lit(True).alias("known")).distinct()
    shared = keys.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).join(known, "digest", "left").where("n > 1 or known")
    shared = common.materialize(shared, "shared-digests")
    spare = common.materialize(keys.join(common.small(shared, 120), "digest").where("known or key > first").select("key", "digest").distinct(), "spare-rows")
    missing = contents.join(common.small(spare, 120), ["key", "digest"], "left_anti").select("digest", "text")
    work(missing).dropDuplicates(["digest"]).select(*schema.names).write.mode("append").parquet(path)
    results = [c for c in schema.names if c not in ("digest", "version")]
    # two runs at once may both have appended a digest: equal results, of which one is taken
    ledger = read(spark, path, schema).where(F.col("version") == version).groupBy("digest").agg(*(F.min(c).alias(c) for c in results))
    return keys.join(ledger, "digest").withColumn("key", F.when(~F.col("no_key"), F.col("key"))).drop("no_key")
