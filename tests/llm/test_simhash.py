"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from assetlake.llm import queries, simhash

SCHEMA = "doc_id long, text string, node long, component string, least int"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints):
    """Least id that each node reaches, over all pairs."""
    h = np.array(prints, np.uint64)
    near = np.bitwise_count(h[:, None] ^ h[None, :]) <= 2
    label = np.arange(len(h))
    while True:
        low = np.array([label[row].min() for row in near])
        low = np.minimum(label, low[low])
        if (low == label).all():
            return label
        label = low


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "c", 3) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "Two WORDS"), (5, "two\nwords"), (6, "É é"), (None, "one"), (7, "long words " * 60_000)]


def test_documents_against_brute_force(spark):
    rng = random.Random(1)
    rows = list(EDGES)
    for n in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 300))]
        rows.append((100 + n, " ".join(words)))
        for k in range(n % 4):
            words[rng.randrange(len(words))] = "changed"
            rows.append((200 + 10 * n + k, "  ".join(words).upper()))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(prints)
    least = {c: min((i for (i, _), x in zip(rows, label, strict=True) if x == c and i is not None), default=None) for c in set(label)}
    assert got == {(i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True)}


@pytest.mark.parametrize("bucket", [4, 64, 2048])
def test_links_of_dense_families(spark, bucket):
    """Chains of single flips and balls around a few points: more links than a bucket takes, at every level."""
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    for centre in list(prints)[:4]:
        prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(100)}
    x = rng.getrandbits(64)
    for n in range(60):
        x ^= 1 << n
        prints.add(x)
    low = rng.getrandbits(64) & ~0xFF
    prints |= {low | n for n in range(256)}  # all that differ in eight bits only
    prints = sorted(prints)
    label = plain_components(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "node long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(nodes, bucket).collect()]
    assert all((a ^ b).bit_count() <= 2 * 64 for a, b in links)
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(p) for p in prints] == [prints[c] for c in label]


def test_nothing_and_extra_columns(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    got = simhash.near_duplicates(table(spark, [(None, "a b c d"), (None, "a b c d")]))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and [tuple(r)[::2] for r in got.collect()] == [(None, None)] * 2


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(prints)
    least = {c: min(i for (i, _), x in zip(rows, label, strict=True) if x == c) for c in set(label)}
    got = queries.op12_simhash(spark, SF).orderBy("doc_id").collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True))
    assert queries.op12_simhash(spark, SF).where(F.col("component_id") < F.col("doc_id")).count() > 0
