"""Backlogs of the enrichment steps, and the batch job that works one off."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import expressions as E
from .graph import spread, written

# Most assets of one selection, and batch sizes, per step.
LIMITS = {"embedding": 256, "tag": 256, "ocr": 128, "face": 128}
BATCHES = {"embedding": 32, "tag": 16, "ocr": 8, "face": 8}


def _ready() -> Column:
    return E.live() & (F.col("thumb_status") == "ready")


def pending(assets: DataFrame, step: str) -> DataFrame:
    """All assets that wait for ``step``: content_hash, thumb, dhash, embedding, tag, ocr or face."""
    waits = {"content_hash": E.live() & F.col("content_hash").isNull(), "thumb": E.live() & (F.col("thumb_status") == "pending"), "dhash": _ready() & F.col("dhash").isNull()}
    return assets.where(waits[step] if step in waits else _ready() & (F.col(f"{step}_status") == "pending"))


def backlog(assets: DataFrame, step: str, limit: int | None = None) -> DataFrame:
    """The assets of the next selection, oldest first; at most the step's limit."""
    most = LIMITS[step]
    return pending(assets, step).orderBy("indexed_at", "id").limit(min(max(limit or most, 1), most))


def in_batches(chosen: DataFrame, step: str) -> DataFrame:
    """The selection with batch numbers from 0; a selection is bounded by its limit."""
    n = F.row_number().over(Window.orderBy("indexed_at", "id")) - 1
    return chosen.withColumn("batch", F.floor(n / BATCHES[step]).cast("long"))


def backlog_counts(assets: DataFrame) -> DataFrame:
    """(step, status, assets) over live assets; embedding and tag only count those with a thumbnail. One pass."""
    return step_statuses(assets).groupBy("step", "status").agg(F.count(F.lit(1)).alias("assets"))


def step_statuses(assets: DataFrame) -> DataFrame:
    """(step, status): the rows that ``backlog_counts`` counts; its table is kept up by ``rollup.changed_counts`` over those of changed assets."""
    steps = F.array(
        *(
            F.struct(F.lit(step).alias("step"), F.when(_ready() if step in ("embedding", "tag") else E.live(), F.col(f"{step}_status")).alias("status"))
            for step in ("embedding", "tag", "ocr", "face")
        )
    )
    return assets.where(E.live()).select(F.explode(steps).alias("s")).select("s.step", "s.status").where("status is not null")


def face_totals(faces: DataFrame) -> DataFrame:
    """One row: faces, those without a cluster, and clusters with faces."""
    none = F.count(F.when(F.col("cluster_id").isNull(), 1))
    return faces.agg(F.count(F.lit(1)).alias("faces"), none.alias("unclustered"), F.countDistinct("cluster_id").alias("clusters"))


def run_scorer(chosen: DataFrame, fn: Callable, result_type: str, batch: int, plain: bool = False) -> DataFrame:
    """(id, result, error) of ``fn`` over batches of rows with ``id``; ``fn`` returns id and result.

    A batch that raises is tried again row by row, so one bad row fails alone;
    rows without a result fail too. ``fn`` takes and returns data frames of
    pandas; if ``plain``, dicts of columns as lists, which spares the making of a
    frame for each call (most of the time where many batches have a bad row).
    """
    if plain:
        return _run_plain(chosen, fn, result_type, batch)

    def score(parts):
        for part in parts:
            cut = lambda i, j: part.iloc[i:j]  # noqa: B023, E731
            ids, results, errors = _scored(fn, cut, part["id"].tolist(), batch)
            yield pd.DataFrame({"id": ids, "result": pd.Series(results, dtype=object), "error": pd.Series(errors, dtype=object)})

    return spread(chosen).mapInPandas(score, f"id long, result {result_type}, error string")


def _run_plain(chosen: DataFrame, fn: Callable[[dict], dict], result_type: str, batch: int) -> DataFrame:
    schema = to_arrow_schema(T.StructType.fromDDL(f"id long, result {result_type}, error string"))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = part.to_pydict()
            cut = lambda i, j: {name: values[i:j] for name, values in columns.items()}  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(_scored(fn, cut, columns["id"], batch), schema, strict=True)], schema=schema)

    return spread(chosen).mapInArrow(score, f"id long, result {result_type}, error string")


def _scored(fn: Callable, cut: Callable, ids: list, batch: int) -> tuple[list, list, list]:
    """(ids, results, errors) of all rows in batches; ``cut(i, j)`` are the rows from i to under j."""
    results, errors = [], []
    for at in range(0, len(ids), batch):
        _isolated(fn, cut, ids, at, min(at + batch, len(ids)), results, errors)
    return ids, results, errors


def _isolated(fn: Callable, cut: Callable, ids: list, low: int, high: int, results: list, errors: list) -> None:
    """Adds result and error of each row from ``low`` to under ``high``; the first result of an id counts."""
    try:
        got = fn(cut(low, high))
        found, values = (c.tolist() if hasattr(c, "tolist") else c for c in (got["id"], got["result"]))
        known = dict(zip(reversed(found), reversed(values), strict=True))
    except Exception as e:  # noqa: BLE001  the worker's own failures are results here
        if high - low > 1:
            for i in range(low, high):
                _isolated(fn, cut, ids, i, i + 1, results, errors)
            return
        results.append(None)
        errors.append(f"{type(e).__name__}: {e}")
        return
    for i in range(low, high):
        result, error = _judged(known.get(ids[i]))
        results.append(result)
        errors.append(error)


def _judged(result) -> tuple:
    """(result, error); neither None nor NaN is a result."""
    missing = result is None or (not hasattr(result, "__len__") and result != result)
    return (None, "no result") if missing else (result, None)


def merge_results(assets: DataFrame, results: DataFrame, step: str, column: str | None = None) -> DataFrame:
    """``assets`` after a batch: a result is stored in ``column`` and the step is ready, an error makes it failed."""
    got = results.select("id", F.col("result").alias("_result"), F.col("error").alias("_error"), F.lit(True).alias("_done"))
    joined = assets.join(got, "id", "left")
    ok = F.col("_done") & F.col("_error").isNull()
    value = {f"{step}_status": F.when(ok, "ready").when(F.col("_done"), "failed").otherwise(F.col(f"{step}_status"))}
    if column:
        value[column] = F.when(ok, F.col("_result")).otherwise(F.col(column))
    return joined.select(*(value.get(c, F.col(c)).alias(c) for c in assets.columns))


def enrich_once(assets: DataFrame, step: str, fn: Callable[[pd.DataFrame], pd.DataFrame], result_type: str, column: str | None = None) -> DataFrame:
    """``assets`` after one selection of the step's backlog went through ``fn`` in batches; what a tick of the enrichment loop does."""
    results = run_scorer(backlog(assets, step), fn, result_type, BATCHES[step])
    return merge_results(assets, written(results), step, column)


def fallback_vectors(keys: DataFrame, dims: int = 512) -> DataFrame:
    """(image_id, embedding) derived from the bytes of ``key`` alone: a stand-in where no model is installed."""
    import hashlib

    import numpy as np

    def vectors(parts):
        for part in parts:
            out = []
            for key in part["key"]:
                raw = b"".join(hashlib.blake2b(key.encode() + n.to_bytes(4, "little"), digest_size=64).digest() for n in range(-(-dims * 4 // 64)))
                v = np.frombuffer(raw[: dims * 4], "<u4").astype(np.float64) / (2**31) - 1
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pd.DataFrame({"image_id": part["image_id"], "embedding": out})

    return keys.select("image_id", F.coalesce("key", F.lit("")).alias("key")).mapInPandas(vectors, "image_id long, embedding array<float>")


def ocr_text(lines: Column) -> Column:
    """Text of recognised lines (arrays of at least three fields, the second the text): trimmed, blank ones dropped."""
    usable = F.filter(lines, lambda x: F.size(x) >= 3)
    return F.array_join(F.filter(F.transform(usable, lambda x: F.trim(F.get(x, F.lit(1)))), lambda x: x != ""), "\n")
