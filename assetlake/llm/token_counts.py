"""Token counts from a digest cache.

The cache is a ledger keyed by the SHA-256 digest of the normalised content and
the digest of the tokenizer's file. Normalising must not change a count, so it
is only that a null text counts as empty. Distinct misses are encoded by the
tokenizer's own library and appended to the cache.

Defined cases: null and empty texts have 0 bytes and what the library returns
for an empty text; very long texts are encoded whole; repeated rows get a row
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, ledger

LIMIT = 4096
CACHE = T.StructType(
    [
        T.StructField("digest", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """texts -> token counts, without begin, end or other added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``; ``cache``: the ledger's folder, kept between runs."""
    version = tokenizer_version(tokenizer)

    def encode(missing: DataFrame) -> DataFrame:
        def count(rows):
            encoder = _encoder(tokenizer)
            for batch in common.batches(rows, 1 << 19):
                texts = batch["text"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "digest": pa.array(batch["digest"], pa.string()),
                        "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                        "n_tokens": pa.array(encoder(texts), pa.int64()),
                    }
                )

        return missing.mapInArrow(count, "digest string, n_bytes long, n_tokens long").withColumn("version", F.lit(version))

    contents = common.texts_of(docs, id_col).withColumnRenamed("doc_id", "key")
    counted = ledger.results_by_key(contents, cache or ledger.fresh_path(docs.sparkSession, "token-counts"), version, CACHE, encode)
    return counted.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
