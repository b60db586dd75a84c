"""The stored index against a plain search over the same assets, also after changes."""

import math
import random
import re

import pytest

from assetlake.operators import graph, textindex, textsearch

SCHEMA = "id long, filename string, ocr_text string, deleted_at long"


def plain_search(assets, queries):
    """query id -> [(score, id)], best first, by counting in every text."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    docs = {i: [words(f), words(t)] for i, f, t, _ in assets}
    live = {i for i, _, _, gone in assets if gone is None}
    average = sum(len(c) for d in docs.values() for c in d) / len(docs)
    out = {}
    for q, text in queries:
        asked = [tuple(words(p)) for p in text.split() if words(p)]
        tfs = {p: {i: n for i, d in docs.items() if (n := sum(tuple(c[j : j + len(p)]) == p for c in d for j in range(len(c))))} for p in set(asked)}
        if not asked:
            continue
        found = []
        for i in live.intersection(*(tfs[p] for p in asked)):
            size, score = sum(map(len, docs[i])), 0
            for p in asked:
                idf = max(math.log((len(docs) - len(tfs[p]) + 0.5) / (len(tfs[p]) + 0.5)), 1e-6)
                score += idf * tfs[p][i] * 2.2 / (tfs[p][i] + 1.2 * (0.25 + 0.75 * size / average))
            found.append((score, i))
        out[q] = sorted(found, key=lambda x: (-x[0], x[1]))
    return out


def random_assets(rng, ids):
    vocabulary = [f"w{n}" for n in range(60)]
    weights = [1 / (n + 1) for n in range(60)]
    text = lambda: " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))
    return [(i, f"pic_{i % 7}-{rng.choice('abc')}.png", rng.choice((None, text(), text(), text().replace(" ", ", "))), 5 if rng.random() < 0.1 else None) for i in ids]


QUERIES = [(n, q) for n, q in enumerate(["w0", "w1 w2", "w0-w1", '"w0" w0', "w3 w0-w0", "w59", "absent w0", "", "---", "pic-3 w5", "png", "w0 w1 w2 w3", "w1-w0-w2", "W4"])]


@pytest.fixture(scope="module")
def searches(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def check(got, assets, first, n):
    wanted = plain_search(assets, QUERIES)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.id, r.total))
    for q, found in wanted.items():
        rows = sorted(by.get(q, []))
        score = {i: s for s, i in found}
        assert [r[0] for r in rows] == list(range(first + 1, first + 1 + len(found[first : first + n])))
        assert [r[1] for r in rows] == pytest.approx([s for s, _ in found[first : first + n]], abs=2e-6)
        assert [r[1] for r in rows] == pytest.approx([score[r[2]] for r in rows], abs=2e-6) and len({r[2] for r in rows}) == len(rows)
        assert all(r[3] == len(found) for r in rows)
    assert set(by) <= set(wanted)


@pytest.mark.parametrize(("limit", "offset"), [(3, 0), (10, 4), (500, 0)])
def test_search_and_index_against_counting(spark, searches, limit, offset, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_IDS", 16)
    assets = random_assets(random.Random(1), range(400))
    df = spark.createDataFrame(assets, SCHEMA)
    path = graph.fresh_path(spark, "test-index")
    assert textindex.write_index(df, path) == 1
    check(textindex.search_index(spark, path, searches, limit, offset), assets, offset, limit)
    check(textsearch.search(df, searches, limit, offset), assets, offset, limit)
    with pytest.raises(ValueError, match="there is an index"):
        textindex.write_index(df, path)


def test_changes_in_two_versions(spark, searches, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_IDS", 16)
    rng = random.Random(2)
    now = {a[0]: a for a in random_assets(rng, range(300))}
    path = graph.fresh_path(spark, "test-index")
    textindex.write_index(spark.createDataFrame(list(now.values()), SCHEMA), path)
    for step in range(2):
        before = rng.sample(sorted(now), 80)
        gone, changed = before[:30], before[30:]
        after = random_assets(rng, [*changed, *range(1000 + 100 * step, 1040 + 100 * step)])
        assert textindex.update_index(path, spark.createDataFrame([now[i] for i in before], SCHEMA), spark.createDataFrame(after, SCHEMA)) == step + 2
        for i in gone:
            del now[i]
        now |= {a[0]: a for a in after}
        check(textindex.search_index(spark, path, searches, 12), list(now.values()), 0, 12)
    kept = textindex.bounds_kept(spark, path).first()
    held = {(w, i) for i, f, t, _ in now.values() for c in (f, t) for w in re.split(r"[\W_]+", (c or "").lower()) if w}
    assert kept.postings == len(held) and kept.tokens == len({w for w, _ in held})


def test_a_search_reads_only_its_buckets(spark):
    assets = random_assets(random.Random(3), range(50))
    path = graph.fresh_path(spark, "test-index")
    textindex.write_index(spark.createDataFrame(assets, SCHEMA), path)
    found = textindex._wanted(textindex.read(spark, path, "postings"), spark.createDataFrame([("w1", False)], "token string, placed boolean"), [3])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]


def test_version_that_broke_off_is_not_read(spark, searches):
    assets = random_assets(random.Random(4), range(60))
    path = graph.fresh_path(spark, "test-index")
    df = spark.createDataFrame(assets, SCHEMA)
    textindex.write_index(df, path)
    spark.createDataFrame([(0,)], "id long").write.parquet(f"{path}/superseded/version=2")  # no numbers: not whole
    check(textindex.search_index(spark, path, searches, 5), assets, 0, 5)
    assert textindex.update_index(path, df.where("id < 0"), df.where("id < 0")) == 2


def test_empty_corpus(spark, searches):
    path = graph.fresh_path(spark, "test-index")
    textindex.write_index(spark.createDataFrame([], SCHEMA), path)
    assert textindex.search_index(spark, path, searches).count() == 0
