"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from conftest import SF
from pyspark.sql import functions as F

from assetlake.llm import common, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, seq int, hash string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [r[-1] for r in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += p not in children
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, own_ids in members.items():
        ends = ",".join(str(c) for c in sorted(own_ids) if len(paths[c]) == len(p))
        out.append((min(own_ids), len(p), min(members[p[:-1]]) if p else None, len(own_ids), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "d") for r in rows], SCHEMA)


ODD = [(None, 1, "user", "nobody"), (0, None, None, None), (0, None, "user", "a"), (0, 1, "user", "a"), (0, 1, "user", "a"), (1, 5, "user", "é" * 70_000), (2, 1, "", ""), (300, 1, "user", "x"), (1_000_000_007, 2, "assistant", "b")]


def random_rows(rng, convs, most=9, texts=3):
    return [(c, t, rng.choice(("user", "assistant")), f"t{rng.randrange(texts)}" * rng.randint(0, 2)) for c in convs for t in range(rng.randint(1, most))]


def test_rebuilt_conversations_against_dictionaries(spark):
    rng = random.Random(3)
    rows = ODD + random_rows(rng, [*range(3, 60), *range(100, 130), *range(410, 440)])
    got = prefix_trie.prefix_nodes(table(spark, rows), prefix_trie.shared_turns(F.col("conv_id")))
    assert found(got) == plain_nodes(rows)


def test_own_turns_only(spark):
    rng = random.Random(4)
    rows = random_rows(rng, range(150), 20, 2) + [(c, t, "user", "same") for c in range(150, 230) for t in range(c % 3 + 1)] + [(c, t, "user", f"chain {t}") for c in range(300, 320) for t in range(c - 299)]
    assert found(prefix_trie.prefix_nodes(table(spark, rows))) == plain_nodes(rows, rebuild=False)


def test_one_conversation_in_several_parts(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(3000)] + [(c, t, "user", f"t{t % 7}") for c in (7, 9) for t in range(40 * c)] + [(9, 999, "user", "other")]
    assert found(prefix_trie.prefix_nodes(table(spark, rows))) == plain_nodes(rows, rebuild=False)


def test_nothing_and_turnless(spark):
    assert found(prefix_trie.prefix_nodes(table(spark, []))) == []
    lone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "all its turns are cut")]
    got = found(prefix_trie.prefix_nodes(table(spark, rows), prefix_trie.shared_turns(F.col("conv_id"))))
    assert got == plain_nodes(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_search_finds_the_exit_of_every_path(spark):
    """Paths against a trie of other ones: the depth that is met, and handles at the two-fattest depths."""
    rng = random.Random(8)
    rows = random_rows(rng, range(120), 40, 2) + [(c, t, "user", f"c{t}") for c in range(200, 240) for t in range(rng.randint(1, 60))]
    turns = common.materialize(prefix_trie.ordered_turns(table(spark, rows)), "test-turns")
    paths, ends = prefix_trie.rebuilt_paths(turns)
    distinct = ends.groupBy("hash", "length").agg(F.min("conv_id").alias("seq"))
    half = distinct.where("seq % 2 = 0")
    deepest = distinct.agg(F.max("length")).first()[0]
    trie = prefix_trie.insert(spark.createDataFrame([], prefix_trie._TRIE), half.select("seq", "length"), paths, deepest)
    hashes = {(r.seq, r.depth): bytes(r.hash) for r in paths.collect()}
    for r in trie.collect():
        fat = max(range(r.lo + 1, r.hi + 1), key=lambda d: d & -d)
        assert (bytes(r.handle), bytes(r.first), bytes(r.ext)) == tuple(hashes[r.seq, d] for d in (fat, r.lo + 1, r.hi))
    known = {hashes[r.seq, d] for r in half.collect() for d in range(1, r.length + 1)}
    other = distinct.where("seq % 2 = 1").select("seq", "length")
    got = {r.seq: r for r in prefix_trie.exit_edges(trie, other, paths, deepest).collect()}
    assert len(got) == other.count() and any(r.e_seq is not None for r in got.values())
    for r in got.values():
        assert r.met == sum(hashes[r.seq, d] in known for d in range(1, r.length + 1))


def test_query_against_dictionaries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_prefix_trie(spark, SF)) == plain_nodes(rows)
