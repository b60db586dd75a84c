"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A new place in the folder that driver and executors share: ``spark.checkpoint.dir``; one of this machine only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/assetlake-tables"
    return f"{folder.rstrip('/')}/catalog/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: rounds don't pile up lineage."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is a mere scan of fewer parts than half of them: a small file is one task else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores // 2 else df


def multiplied(df: DataFrame) -> DataFrame:
    """``df``, whose rows an explode has multiplied, to be joined by a shuffle: Spark takes it for as small as it was before and would send it whole through the driver."""
    return df.hint("merge")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of the nodes of ``edges`` (a, b): the least id of each component.

    Labels move to the least neighbour's, and then to their label's label
    (pointer jumping), so that long chains take a logarithmic number of rounds.
    """
    pairs = edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(pairs.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    for _ in range(rounds):
        near = pairs.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "id").select("id", F.least("component", "near").alias("up"), "component")
        roots = moved.select(F.col("id").alias("up"), F.col("up").alias("above"))
        after = written(moved.join(roots, "up", "left").select("id", F.least("up", "above").alias("component"), (F.least("up", "above") < F.col("component")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.drop("moved")
        labels = after.drop("moved")
    raise RuntimeError(f"the components have not settled in {rounds} rounds")
