"""Catalogs in buckets: the same next version as by classify and apply, and no exchange in its join."""

import random

from pyspark.sql import functions as F

from assetlake import schemas
from assetlake.operators import buckets, reconcile


def test_next_version(spark):
    rng = random.Random(1)
    rows = [(n, n % 3, f"p{n}", rng.randrange(3), rng.randrange(3), rng.choice((None, 7))) for n in range(1, 200)]
    given = {k: F.lit(v) for k, v in schemas.FRESH.items()}
    named = spark.createDataFrame(rows, "id long, root_id long, rel_path string, size_bytes long, mtime long, deleted_at long")
    prev = named.select(*(given.get(f.name, F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ASSETS))
    found = [(n % 3, f"p{n}", f"p{n}", "png", rng.randrange(3), rng.randrange(3)) for n in range(80, 300)]
    listing = spark.createDataFrame(found + found[:5], "root_id long, rel_path string, filename string, extension string, size_bytes long, mtime long")
    a, b = buckets.write_buckets(prev, "assets", 4), buckets.write_buckets(listing, "listing", 4)
    key = lambda df: sorted(map(str, df.collect()))
    for complete in (True, False):
        wanted = reconcile.apply_changes(prev, reconcile.classify(prev, listing, complete), 99)
        assert key(buckets.next_version(a, b, 99, complete)) == key(wanted)
    whole = a.withColumn("known", F.lit(True)).join(b.dropDuplicates(reconcile.KEY), reconcile.KEY, "full_outer")
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
