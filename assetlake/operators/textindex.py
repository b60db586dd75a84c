"""A stored inverted index: postings by token, kept up with changes, searched by the bounds of blocks.

Layout, as Parquet below one folder (``version`` and ``bucket`` are partitions):

* ``postings``: (token, block, id, tokens, tf, places, live), sorted by token in
  the buckets of its hash, so a search reads the buckets of its words only;
* ``blocks``: (token, block, n, most, least): of the ``BLOCK_IDS`` ids of a block,
  how many have the token, its greatest frequency and their least length;
* ``superseded``: (id): assets whose earlier versions no longer count;
* ``numbers``: (docs, words) of the corpus.

A change set is one more version: the postings of what was added or changed, the
ids of all that changed, and blocks and numbers whose counts are negative where
rows went. Counts are therefore sums over versions, and bounds, the greatest
over versions, stay bounds. A version whose write breaks off has no ``numbers`` and is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textmatch as M, textsearch as S
from .graph import spread, written

BUCKETS = 64
BLOCK_IDS = 256
#: Blocks of a query that are scored first; their k-th best score is what other blocks must reach.
FIRST_BLOCKS = 4

_SCHEMAS = {
    "postings": "token string, block long, id long, tokens long, tf long, places array<struct<col:int,pos:int>>, live boolean, version int, bucket int",
    "blocks": "token string, block long, n long, most long, least long, version int, bucket int",
    "superseded": "id long, version int",
    "numbers": "docs long, words long, version int",
}


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def block_of(asset_id: Column) -> Column:
    return F.floor(asset_id / BLOCK_IDS).cast("long")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions: those whose numbers, which come last, are there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/numbers")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=")]
    whole = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in whole)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the index, its whole versions only."""
    versions = _versions(spark, path)
    rows = spark.read.schema(_SCHEMAS[table]).option("basePath", f"{path}/{table}")
    return rows.parquet(*(f"{path}/{table}/version={v}" for v in versions)) if versions else spark.createDataFrame([], _SCHEMAS[table])


def _numbers(assets: DataFrame) -> DataFrame:
    return S.tokenised(assets).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("words"))


def _write(spark: SparkSession, path: str, before: DataFrame | None, after: DataFrame) -> int:
    """One version: ``after`` takes the place of ``before`` (assets as they were)."""
    version = (_versions(spark, path) or [0])[-1] + 1
    after = spread(after)
    place = lambda table: f"{path}/{table}/version={version}"
    # a bucket's tokens spread over tasks by block, so a frequent one is no single task's
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.pmod(F.xxhash64("block"), F.lit(-(-4 * tasks // BUCKETS))).cast("int")
    placed = lambda rows: rows.withColumn("block", block_of(F.col("id"))).withColumns({"bucket": bucket_of(F.col("token")), "split": split})
    rows = placed(S.postings_of_rows(after)).drop("block").repartition(tasks, "bucket", "split").withColumn("block", block_of(F.col("id"))).sortWithinPartitions("bucket", "token", "block", "id")
    rows = rows.select("token", "block", "id", "tokens", F.size("spots").cast("long").alias("tf"), S.places_of(F.col("spots")).alias("places"), "live", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(place("postings"))
    now = spark.read.schema(_SCHEMAS["postings"]).parquet(place("postings"))
    counted = placed(now).select("bucket", "split", "token", "block", F.lit(1).cast("long").alias("n"), F.col("tf").alias("most"), F.col("tokens").alias("least"))
    numbers = _numbers(after)
    if before is not None:
        gone = placed(S.postings_of_rows(before)).select("bucket", "split", "token", "block", F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("most"), F.lit(None).cast("long").alias("least"))
        counted = counted.unionByName(gone)
        numbers = numbers.unionByName(_numbers(before).select((-F.col("docs")).alias("docs"), (-F.col("words")).alias("words"))).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        before.select("id").unionByName(after.select("id")).distinct().write.mode("overwrite").parquet(place("superseded"))
    else:
        spark.createDataFrame([], "id long").write.mode("overwrite").parquet(place("superseded"))
    # the aggregate's keys hold those by which its rows were dealt, so they move once
    blocks = counted.repartition(tasks, "bucket", "split").groupBy("bucket", "split", "token", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))
    blocks.drop("split").sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy("bucket").parquet(place("blocks"))
    numbers.write.mode("overwrite").parquet(place("numbers"))  # the last: now the version counts
    return version


def write_index(assets: DataFrame, path: str) -> int:
    """The first version of an index of all ``assets`` (id, filename, ocr_text, deleted_at); its number."""
    spark = assets.sparkSession
    if _versions(spark, path):
        raise ValueError(f"there is an index at {path}")
    return _write(spark, path, None, assets)


def update_index(path: str, before: DataFrame, after: DataFrame) -> int:
    """One more version, for the changed assets: ``before`` as the index has them, ``after`` as they are now.

    An added asset is in ``after`` only, one that is gone in ``before`` only, a changed or deleted one in both.
    """
    return _write(after.sparkSession, path, before, after)


# --- search -----------------------------------------------------------------------


def _wanted(table: DataFrame, tokens: DataFrame, buckets: list[int]) -> DataFrame:
    """The rows of the asked tokens; the partitions of their buckets only."""
    return table.where(F.col("bucket").isin(buckets)).join(tokens, "token")


def _valid(postings: DataFrame, superseded: DataFrame) -> DataFrame:
    """Without the postings of assets that a later version changed."""
    latest = superseded.groupBy("id").agg(F.max("version").alias("latest"))  # as many as ever changed
    return postings.join(latest, "id", "left").where("latest is null or version >= latest").drop("latest")


def search_index(spark: SparkSession, path: str, queries: DataFrame, limit: int = 500, offset: int = 0, totals: bool = True) -> DataFrame:
    """What ``textsearch.search`` finds, from the index: (query_id, id, score, rank, total); ``total`` only with ``totals``.

    A query's blocks of ids are ordered by what they can score at most. The best
    ones are scored; of the others only those whose bound reaches the last score
    that the page needs so far. Scores are exact, and so is the page.
    """
    asked = written(S.asked_phrases(queries))
    tokens = written(S.asked_words(asked))
    buckets = [r.bucket for r in tokens.select(bucket_of(F.col("token")).alias("bucket")).distinct().collect()]  # at most BUCKETS
    numbers = read(spark, path, "numbers").agg(F.sum("docs").alias("docs"), F.try_divide(F.sum("words"), F.sum("docs")).alias("average"))
    blocks = _wanted(read(spark, path, "blocks"), tokens, buckets).groupBy("token", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))
    all_found, superseded = _wanted(read(spark, path, "postings"), tokens, buckets), read(spark, path, "superseded")
    found = _valid(all_found, superseded)
    if totals:  # every match counts, so no block can be left out
        return _with_totals(asked, all_found, superseded, numbers, limit, offset)
    # phrases of several words have to be matched to be counted; single words are counted in the blocks
    long = asked.where("size(words) > 1")
    hits = S.phrase_hits(found, asked, ("block", "live"))
    long_hits = written(S.phrase_hits(_valid(found, superseded).join(S.asked_words(long).select("token"), "token", "left_semi"), long, ("block", "live")))
    held = blocks.where("n > 0").select(F.col("token").alias("phrase"), "block", "n", "most", "least").join(asked.where("size(words) = 1").select("phrase").distinct(), "phrase")
    held = written(held.unionByName(long_hits.groupBy("phrase", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("tokens").alias("least"))))
    weights = written(S.weighed(asked, held.groupBy("phrase").agg(F.sum("n").alias("df")), numbers))
    bound = F.sum(F.col("weight") * S.impact(F.col("most"), F.col("least"), F.col("average")))
    open_blocks = weights.join(held, "phrase").groupBy("query_id", "block", "phrases").agg(bound.alias("bound"), F.count(F.lit(1)).alias("n")).where("n = phrases")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    open_blocks = written(open_blocks.select("query_id", "block", "bound", F.row_number().over(order).alias("place")))
    hits, first = hits.where("live"), max(0, offset)
    last = first + min(max(limit, 1), 500)
    score = lambda chosen: S.scored(hits, weights.join(chosen.select("query_id", "block"), "query_id"), ("block",))
    best = written(score(open_blocks.where(F.col("place") <= FIRST_BLOCKS)))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") == last)
    reach = ranked.select("query_id", F.col("score").alias("least"))
    margin = 10.0**-S.DIGITS  # scores are rounded, bounds are not
    others = open_blocks.where(F.col("place") > FIRST_BLOCKS).join(reach, "query_id", "left").where((F.col("least").isNull()) | (F.col("bound") + margin >= F.col("least")))
    return S.page(best.unionByName(score(others)), limit, offset)


def _with_totals(asked: DataFrame, found: DataFrame, superseded: DataFrame, numbers: DataFrame, limit: int, offset: int) -> DataFrame:
    """The page with totals: the postings of each asset in one row, which searches meet in blocks."""
    phrases, numbers = M.numbered_phrases(asked), written(numbers)
    count = F.array_repeat("number", F.col("tf").cast("int"))
    rows = found.join(M.single_words(phrases), "token").groupBy("id", "version", "tokens", "live").agg(F.flatten(F.collect_list(count)).alias("numbers"))
    rows = _valid(rows, superseded).drop("version")  # by asset, not by posting
    long = phrases.where("size(words) > 1")
    if not long.isEmpty():
        rows = M.with_long(rows, S.phrase_hits(_valid(found, superseded).join(S.asked_words(long).select("token"), "token", "left_semi"), long, ("live",)), phrases)
    rows = written(rows)
    return M.best(rows, M.searches_of(asked, phrases, rows, numbers), numbers.first()["average"], limit, offset)


def bounds_kept(spark: SparkSession, path: str) -> DataFrame:
    """One row: tokens, blocks and postings of the index, for its upkeep."""
    blocks = read(spark, path, "blocks").groupBy("token", "block").agg(F.sum("n").alias("n")).where("n > 0")
    return blocks.agg(F.countDistinct("token").alias("tokens"), F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("postings"))
