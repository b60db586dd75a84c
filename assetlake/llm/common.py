"""Shared pieces: written intermediate tables, checked broadcasts, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a broadcast: counted rows times the bytes that a row of it takes.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20
#: Rows of a batch that a Parquet reader decodes; a text column of 4096 rows takes tens of MB.
READER_ROWS = 512
#: Words in a shingle and the similarity of near-duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jsc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc_dir.isDefined():
            path = jsc_dir.get()
        else:
            path = "file://" + tempfile.mkdtemp(prefix="spark-assetlake-")
            spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/assetlake"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: int = 32) -> DataFrame:
    """Hint a broadcast of ``df`` only if its counted rows of ``width`` bytes stay within BROADCAST_BYTES; otherwise Spark joins by shuffling."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def bounded_batches(spark: SparkSession) -> None:
    """Batches of this session fit for texts: Spark's own bounds hold many times what a task works on at once.

    Arrow batches are bounded by bytes, and a Parquet reader holds so many rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder with a number of its own for each row, and the name of that column."""
    bounded_batches(df.sparkSession)
    key = unused(df, "_key")
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), name), key


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty), whatever other columns there are; read in bounded batches."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


# --- words -----------------------------------------------------------------

_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """Per code point: simple lower case, and whether it belongs to a word (letters and numbers)."""
    if not _tables:
        _tables["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.bool_, 0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(_tables["word"]).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _tables["lower"] = lower
        with np.errstate(over="ignore"):
            power = np.ones(2 * _CHUNK + 2, np.uint64)
            power[1:] = np.uint64(_BASE)
            np.multiply.accumulate(power, out=power)
            inverse = np.ones_like(power)
            inverse[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
            np.multiply.accumulate(inverse, out=inverse)
        _tables["power"], _tables["inverse"] = power, inverse
    return _tables[name]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * _BASE + _BASE & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end (code points) of each word of a text of at most ``2 * _CHUNK`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _table("word")[codes]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((_table("lower")[codes] + np.uint64(1)) * _table("power")[: len(codes)], out=total[1:])
        h = (total[ends] - total[starts]) * _table("inverse")[starts]
    return mix(h), starts, ends


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; very long texts go in pieces cut between words where they have a gap."""
    if len(text) <= _CHUNK:
        return _hash_words(text)
    parts, at = [], 0
    while at < len(text):
        end = min(at + _CHUNK, len(text))
        stop = min(end + _CHUNK, len(text))
        while end < stop and text[end].isalnum():
            end += 1
        h, s, e = _hash_words(text[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def hashed(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, word hashes, starts, ends) of each text; short texts share one pass over their characters."""
    group: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        n = len(texts[i]) + 1 if i < len(texts) else _CHUNK
        if size + n > _CHUNK and group:
            joined = "\n".join(texts[j] for j in group)
            h, s, e = _hash_words(joined)
            begin = np.cumsum([0] + [len(texts[j]) + 1 for j in group])
            cut = np.searchsorted(s, begin)
            for k, j in enumerate(group):
                a, b = cut[k], cut[k + 1]
                yield j, h[a:b], s[a:b] - begin[k], e[a:b] - begin[k]
            group, size = [], 0
        if i < len(texts):
            if n > _CHUNK:
                yield i, *word_hashes(texts[i])
            else:
                group.append(i)
                size += n


def shingles(h: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the runs of ``k`` words, in text order; none for fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= np.uint64(_BASE)
            out += h[j : j + n]
    return mix(out, k)


def whole_hash(h: np.ndarray) -> int:
    """One signed 64-bit hash of a sequence of word hashes."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(len(h), dtype=np.uint64), 7)
        x = np.array([((mix(h ^ place, 3)).sum(dtype=np.uint64)) ^ np.uint64(len(h))], np.uint64)
    return int(mix(x, 11).view(np.int64)[0])


def similar_set(h: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingles; a text of 1 to ``k - 1`` words is one shingle of all its words."""
    if 0 < len(h) < k:
        return shingles(h, len(h))
    return np.unique(shingles(h, k))


def slices(rows: Iterator, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one holds about ``chars`` characters at most: Python objects of a whole batch would stay in a worker."""
    for batch in rows:
        size = max(1, batch.num_rows * chars // max(chars, batch.nbytes))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    release()


def release() -> None:
    """Give free memory back to the system at the end of a task: workers are reused and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hashed_together(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends of all texts one after the other, and the number of the first word of each (and of all)."""
    parts = [(h, s, e) for _, h, s, e in hashed(texts)]
    first = np.concatenate([[0], np.cumsum([len(h) for h, _, _ in parts], dtype=np.int64)]).astype(np.int64)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), first
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, s, e, first


def sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of every ``n`` neighbours."""
    size = 1
    while 2 * size <= n:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def batches(rows: Iterator, chars: int = 1 << 21) -> Iterator[dict[str, list]]:
    """``slices`` as dictionaries of lists."""
    for batch in slices(rows, chars):
        yield batch.to_pydict()
