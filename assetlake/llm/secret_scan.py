"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 digest of its content.
A ledger of (blob, rule version) keeps the findings; only pairs that it lacks
are scanned, each blob once whatever number of paths and versions hold it, and
findings are joined back to all of them.

Rules: ``assign``, ``access`` and ``hex`` are the base rules; ``pem`` (private
key header), ``jwt`` and ``service`` (prefixed service tokens) add spans. Spans
are in code points, end exclusive.

Defined cases: null and empty contents have no findings; long contents are
scanned whole; repeated rows get a row each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, ledger

# The rules' patterns, in the order in which kinds are listed.
_KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
RULES = {
    "assign": _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "pem": "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "service": "(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})",
}
BASE = ("assign", "access", "hex")
SHORTEST_VALUE = 6
SHORTEST_ACCESS = 20
RULE_VERSION = hashlib.sha256(repr((RULES, SHORTEST_VALUE, SHORTEST_ACCESS)).encode()).hexdigest()
LEDGER = T.StructType(
    [T.StructField("digest", T.StringType()), T.StructField("version", T.StringType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())]
)
_COMPILED = {k: re.compile(p) for k, p in RULES.items()}
_HINTS = {"access": "AKIA", "pem": "PRIVATE KEY-----", "jwt": "eyJ"}


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start, then kind as listed."""
    found = []
    for order, (kind, pattern) in enumerate(_COMPILED.items()):
        if kind in _HINTS and _HINTS[kind] not in text or kind == "assign" and "=" not in text and ":" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "assign" and len(m[1]) < SHORTEST_VALUE or kind == "access" and len(m[0]) < SHORTEST_ACCESS:
                continue
            found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_blobs(missing: DataFrame) -> DataFrame:
    def blobs(rows):
        for batch in common.batches(rows):
            out: dict[str, list] = {n: [] for n in LEDGER.names if n != "version"}
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                spans = scan(text)
                out["digest"].append(digest)
                for k in BASE:
                    out[f"n_{k}"].append(sum(s[0] == k for s in spans))
                out["base_spans"].append(_joined([s for s in spans if s[0] in BASE]))
                out["spans"].append(_joined(spans))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items()})

    schema = T.StructType([f for f in LEDGER if f.name != "version"])
    return missing.mapInArrow(blobs, schema).withColumn("version", F.lit(RULE_VERSION))


def _findings(versions: DataFrame, ledger_path: str | None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    contents = common.texts_of(versions, key_col, text_col).withColumnRenamed("doc_id", "key")
    return ledger.results_by_key(contents, ledger_path or ledger.fresh_path(versions.sparkSession, "secrets"), RULE_VERSION, LEDGER, _scan_blobs)


def secret_findings(versions: DataFrame, ledger_path: str | None = None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_spans, spans) for each row of ``versions``; ``ledger_path``: kept between runs."""
    return _findings(versions, ledger_path, key_col, text_col).drop("digest")


def redact(docs: DataFrame, ledger_path: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mask``; ids, rows and all columns stay, ``n_chars`` follows the text.

    A null text stays null. Overlapping spans are masked as one. Texts without a
    finding are not sent to Python; findings are joined by the texts' digests,
    of which there are no more than texts with secrets.
    """
    digest, spans = common.unused(docs, "_digest"), common.unused(docs, "_spans")
    found = _findings(docs, ledger_path).where("spans != ''").select(F.col("digest").alias(digest), F.col("spans").alias(spans)).distinct()
    found = common.materialize(found, "secret-spans")
    text = F.col("text").cast("string")
    marked = docs.withColumn(digest, ledger.content_digest(F.coalesce(text, F.lit("")))).join(common.small(found, 320), digest, "left")
    hit = F.col(spans).isNotNull() & text.isNotNull()

    def hide(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else masked(x, y, mask) for x, y in zip(t, s, strict=True)], dtype=object)

    out = marked.withColumn("text", F.when(hit, F.pandas_udf(hide, "string")(F.when(hit, text), F.col(spans))).otherwise(F.col("text"))).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def masked(text: str, spans: str, mask: str) -> str:
    """``text`` with the ``kind:start:end`` spans replaced."""
    out, at = [], 0
    for span in spans.split(","):
        start, end = map(int, span.split(":")[1:])
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
