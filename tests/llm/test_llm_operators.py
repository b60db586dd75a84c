"""Each operator on small documents: brute force, planted cases and the edge cases that its docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F

from assetlake.llm import common, decontamination, jaccard_join, language_model, ledger, license_scan, links, order_minhash, packing, passages, secret_scan, substring_dedup, token_counts, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long"


def words(rng, n, prefix="w"):
    return [f"{prefix}{rng.randrange(5000)}" for _ in range(n)]


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "k", 7) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one two three four five"), (6, "é" * 3), (6, "é" * 3), (None, "no id at all here today"), (8, "long " * 70_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def corpus():
    """Documents with copies, near copies, a chain, shared paragraphs and short texts."""
    rng = random.Random(5)
    docs = [words(rng, rng.randint(30, 200)) for _ in range(60)]
    out = [(n, " ".join(w)) for n, w in enumerate(docs)]
    for n in range(12):
        w = list(docs[n])
        for _ in range(1 + n % 3):
            w[rng.randrange(len(w))] = "changed"
        out.append((100 + n, " ".join(w)))
        out.append((200 + n, out[n][1].upper()))
    near = list(docs[20])
    for n in range(70):  # a dense group, larger than a bucket for brute force
        w = list(near)
        w[n % len(w)] = f"x{n}"
        out.append((300 + n, " ".join(w)))
    return [*out, (900, "just three words"), (901, "just three words"), (902, "a b c d e"), (903, None), (904, "")]


def shingle_sets(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return sets


# --- shared pieces -------------------------------------------------------------------


def test_hashes_agree_for_any_grouping():
    texts = ["Ab cd, ef_gh", "", "ÉCOLE école", "x" * 300_000 + " y " + "z " * 200_000]
    seen = {i: (h.tolist(), s.tolist(), e.tolist()) for i, h, s, e in common.hashed(texts)}
    assert sorted(seen) == [0, 1, 2, 3]
    for i, t in enumerate(texts):
        h, s, e = common.word_hashes(t)
        assert seen[i] == (h.tolist(), s.tolist(), e.tolist())
        assert [t[a:b] for a, b in zip(s, e, strict=True)] == re.findall(r"[^\W_]+", t)
    assert seen[2][0][0] == seen[2][0][1]


def test_intersections_against_sets():
    rng = np.random.default_rng(0)
    for n in (2, 40, 200):
        sets = [set(rng.integers(0, 60, 30).tolist()) | set(rng.integers(100, 10_000, 20).tolist()) for _ in range(n)]
        got = links.intersections(np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate([list(s) for s in sets]), n)
        assert all(got[a, b] == len(sets[a] & sets[b]) for a in range(n) for b in range(n) if a != b)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(50)] + [(200, x) for x in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for p in pairs if p[0] != p[1] for y in p}}


# --- 1 decontamination -----------------------------------------------------------------


def test_contained_items_against_brute_force(spark):
    rng = random.Random(3)
    items = [(n, " ".join(words(rng, rng.randint(5, 80), "q"))) for n in range(30)] + [(30, None), (31, "too short"), (None, "an item that has no id"), (0, " ".join(words(rng, 20, "r")))]
    docs = []
    for n in range(40):
        w = words(rng, rng.randint(10, 2000))
        item = items[n % 30][1].split()
        if n % 3 == 0:
            item[len(item) // 2] = "other"
        at = rng.randrange(len(w))
        docs.append((n, " ".join(w[:at] + item + w[at:])))
    docs += EDGES
    wanted, sets = [], shingle_sets([(n, t) for n, t in enumerate([t for _, t in docs])])
    for d, (doc_id, _) in enumerate(docs):
        for item_id, text in items:
            if item_id is not None and len(re.findall(r"\w+", text or "")) >= 5:
                (s,) = shingle_sets([(0, text)]).values()
                own = {x for x in sets[d] if len(x) == 5}
                if len(s & own) / len(s) >= 0.8:
                    wanted.append((doc_id, item_id, len(s & own), len(s)))
    got = decontamination.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got.collect()) == sorted(wanted)
    assert len(wanted) > 20


def test_decontaminate_keeps_the_rest(spark, edges, nothing):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert decontamination.decontaminate(edges, items).count() == len(EDGES) - 1
    assert decontamination.decontaminate(edges, items.where("false")).count() == len(EDGES)
    assert decontamination.contaminated(nothing, items).count() == 0


def test_decontaminate_looks_at_texts_not_ids(spark):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = clashing(spark, [(1, "so one two three four five", "a"), (1, "other words stand in this text", "b"), (None, "so one two three four five", "c"), (None, None, "d")])
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r["_key"] for r in left.collect()) == ["b", "d"]


def test_items_of_few_words_are_all_found():
    rng = random.Random(38)
    items = [(n, " ".join(words(rng, 5 + n % 2))) for n in range(3000)]
    texts = [" ".join([*words(rng, 30, "x"), t, *words(rng, 30, "y")]) for _, t in items]
    found = {(d, item) for d, item, _, _ in decontamination._matches(texts, decontamination._Block(items), 0.8)}
    assert found >= {(n, n) for n, _ in items}


# --- 2 packing -------------------------------------------------------------------------


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    wanted = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            wanted[(i, n, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, edges, nothing):
    rng = random.Random(2)
    docs = [(n, " ".join(words(rng, rng.randint(1, 90)))) for n in range(150)]
    used, least = check_packing(packing.pack_documents(table(spark, docs), WORD_BPE, 256).collect(), docs, 256)
    assert used <= least + 1
    odd = EDGES[:-1] + [(9, "It's 3.5% <|endoftext|> Don't, I'M. Σ ſ K"), (10, "a,b.. C,  d\n\ne")]
    check_packing(packing.pack_documents(table(spark, odd), WORD_BPE, 16).collect(), odd, 16)
    assert packing.pack_documents(nothing, WORD_BPE).count() == 0


def whole(packed, lengths, capacity):
    """Whether a packing has every piece once, with right rooms that are not negative."""
    return sorted(i for b in packed.bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) + r == capacity and r >= 0 for b, r in zip(packed.bins, packed.room, strict=True))


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300).tolist()
    people = packing.evolve(lengths, 100, 0, [], generations=6)
    assert all(whole(p, lengths, 100) for p in people)
    assert len(people[0].bins) <= len(packing._start(lengths, 100, rng, True).bins)
    child, displaced = packing._cross(people[0], people[1], 100, rng)
    assert sorted([*displaced, *(i for b in child.bins for i in b)]) == list(range(300))
    child, more = packing._mutate(child, rng)
    left = child.replace(displaced + more, lengths)
    assert sorted([*left, *(i for b in child.bins for i in b)]) == list(range(300)) and sum(lengths[i] for i in left) <= sum(lengths[i] for i in displaced + more)
    child.best_fit(left, lengths, 100)
    assert whole(child, lengths, 100)


def test_evolution_beats_best_fit_where_that_is_not_the_least():
    """Pieces of two to five tenths of a sequence: three fit in one only if they are well chosen."""
    gained, gap = 0, 0
    for seed in range(4):
        lengths = np.random.default_rng(seed).integers(200, 501, 300).tolist()
        best_fit = len(packing._start(lengths, 1000, np.random.default_rng(0), True).bins)
        people = packing.evolve(lengths, 1000, seed, [], generations=200)
        least = -(-sum(lengths) // 1000)
        assert whole(people[0], lengths, 1000) and least <= len(people[0].bins) < best_fit
        gained, gap = gained + best_fit - len(people[0].bins), gap + best_fit - least
    assert gained >= gap / 3


def test_elites_migrate_and_the_best_island_stays(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(200, 1200, 400).tolist()
    rest = spark.createDataFrame(list(enumerate(lengths)), "piece_id long, length long")
    packed = packing._packed(rest, 1, 2048, 0).collect()
    bins = defaultdict(list)
    for r in packed:
        bins[r.bin].append(r)
    assert sorted(r.piece_id for r in packed) == list(range(400))
    assert all(sum(r.length for r in b) == b[0].fill <= 2048 for b in bins.values())
    assert len(bins) <= len(packing._start(lengths, 2048, rng, True).bins)


# --- 3 language model ------------------------------------------------------------------


def lm_tokens(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]


def test_counts_and_base_against_brute_force(spark, edges, nothing):
    rng = random.Random(4)
    docs = [(100 + n, " ".join(("the", "of", rng.choice("abcdef"), f"Rare{rng.randrange(400)}É")[rng.randrange(4)] for _ in range(rng.randint(0, 60)))) for n in range(120)] + EDGES[:-2]
    out = language_model.log_likelihood(table(spark, docs)).collect()
    counts, total = Counter(), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(lm_tokens(t))
    total = sum(counts.values())
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in lm_tokens(t))
    assert len(out) == len(docs)
    by = dict(docs)
    for r in out:
        w = lm_tokens(by[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), total, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base(by[r.doc_id])) and -1e6 < r.score < 0
    # these words are drawn independently, so there is nothing to gain; learning must not lose
    assert sum(r.score for r in out if r.held_out) > 1.05 * sum(r.base_score for r in out if r.held_out)
    assert language_model.log_likelihood(nothing).count() == 0


def small_model():
    vocabulary = language_model.Vocabulary([(f"w{n}".encode(), 600 - n) for n in range(520)] + [(b"\n", 5)], [b"ing", b"ed"], 9000, 521)
    vocabulary.set_class_totals({})
    return language_model.Model(vocabulary.symbols, vocabulary.classes, vocabulary.n_words), vocabulary


def test_gradients_against_differences():
    model, v = small_model()
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    inputs, targets = rng.integers(0, v.symbols, (5, 3)), rng.integers(0, v.symbols, 15)
    resets = [np.array([0]), np.array([], int), np.array([1]), np.array([], int), np.array([], int)]

    def loss():
        states, kept = model.forward(inputs, resets, np.full((3, language_model.HIDDEN), 0.1))
        score, grads, back = model.outputs(states.reshape(15, -1), v.class_of_symbol[targets], targets, v.n_words, True)
        return -score.sum(), grads | model.backward(kept, back.reshape(states.shape))

    _, grads = loss()
    for k in grads:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        held = model.p[k][at]
        model.p[k][at] = held + 1e-2
        up = loss()[0]
        model.p[k][at] = held - 1e-2
        down = loss()[0]
        model.p[k][at] = held
        assert (up - down) / 2e-2 == pytest.approx(grads[k][at], rel=0.03)


def test_state_is_carried_and_documents_stay_apart():
    model, v = small_model()
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, v.symbols, n).astype(np.int32) for n in (1, 40, 100, 7, 333)]
    together = language_model.score(model, v, docs)
    alone = np.array([language_model.score(model, v, [d])[0] for d in docs])
    assert np.allclose(together, alone, rtol=1e-4)
    assert together[4] != pytest.approx(language_model.score(model, v, [docs[4][:32]])[0] + language_model.score(model, v, [docs[4][32:]])[0], rel=1e-6)


def naive_score(model, v, doc):
    """Log10 probability of a document's classes and frequent words, token by token with plain numbers."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p = {k: x.astype(float) for k, x in model.p.items()}
    n, before, h, total = language_model.HIDDEN, v.start, [0.0] * language_model.HIDDEN, 0.0
    for symbol in doc.tolist():
        x = p["input"][before]
        u = [sum(h[i] * p["state"][i, j] for i in range(n)) for j in range(3 * n)]
        z = [sigmoid(x[j] + u[j]) for j in range(n)]
        r = [sigmoid(x[n + j] + u[n + j]) for j in range(n)]
        c = [math.tanh(x[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
        h = [c[j] + z[j] * (h[j] - c[j]) for j in range(n)]
        own = int(v.class_of_symbol[symbol])
        logits = [sum(h[i] * p["class_w"][i, k] for i in range(n)) + p["class_b"][k] for k in range(v.classes)]
        total += logits[own] - math.log(sum(map(math.exp, logits)))
        if symbol < v.n_words:
            place, size = symbol % language_model.CLASS_WORDS, min(language_model.CLASS_WORDS, v.n_words - own * language_model.CLASS_WORDS)
            logits = [sum(h[i] * p["word_w"][own, i, k] for i in range(n)) + p["word_b"][own, k] for k in range(size)]
            total += logits[place] - math.log(sum(map(math.exp, logits)))
        before = symbol
    return total / math.log(10)


def test_scores_against_a_plain_loop():
    model, v = small_model()
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, v.symbols, n).astype(np.int32) for n in (1, 5, 33, 70)]
    assert language_model.score(model, v, docs) == pytest.approx([naive_score(model, v, d) for d in docs], rel=1e-4)


def test_probabilities_sum_to_one():
    model, v = small_model()
    states = np.random.default_rng(2).standard_normal((1, language_model.HIDDEN)).astype(np.float32)
    symbols = np.arange(v.symbols)
    score, _, _ = model.outputs(np.repeat(states, v.symbols, 0), v.class_of_symbol[symbols], symbols, v.n_words, False)
    assert np.exp(score.astype(float)).sum() == pytest.approx(1, rel=1e-4)


# --- 4 Jaccard join --------------------------------------------------------------------


def brute_join(rows):
    sets = shingle_sets(rows)
    texts = {i: tuple(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    first = {}
    for i in sorted(texts):
        if texts[i]:
            first.setdefault(texts[i], i)
    reps = sorted(first.values())
    near = defaultdict(set)
    for a, b in combinations(reps, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for i in texts:
        if not texts[i]:
            out[i] = (i, 0, 0)
            continue
        seen, todo = set(), [first[texts[i]]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        out[i] = (min(seen), len(near[first[texts[i]]]), sum(t == texts[i] for t in texts.values()) - 1)
    return out


def test_join_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.similar_documents(table(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_join_edges(spark, edges, nothing):
    out = jaccard_join.similar_documents(edges).collect()
    assert len(out) == len(EDGES) and {r.doc_id: r.n_copies for r in out}[6] == 1
    assert jaccard_join.similar_documents(nothing).count() == 0
    kept = jaccard_join.one_of_each(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


CLASHES = "doc_id long, text string, _key string, _DIGEST string, _spans string, row long, node long, grp long, tile long, digest string, n_chars long"


def clashing(spark, rows):
    """Documents (id, text, mark) with the names that operators use for columns of their own."""
    return spark.createDataFrame([(i, t, mark, "d", "s", 1, 2, 3, 4, "x", len(t or "")) for i, t, mark in rows], CLASHES)


def test_one_of_each_keeps_rows_that_share_an_id_apart(spark):
    rng = random.Random(4)
    long, other, third = (" ".join(words(rng, 60)) for _ in range(3))
    docs = clashing(spark, [(1, long, "a"), (2, long, "b"), (2, other, "c"), (None, long, "d"), (None, third, "e"), (None, third, "f"), (9, None, "g"), (9, None, "h")])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_key"] for r in kept.collect())[:2] == ["a", "c"] and kept.count() == 5 and kept.where("_key in ('e', 'f')").count() == 1
    assert jaccard_join.one_of_each(docs.where("false")).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs_needed(recall=0.5) < jaccard_join.runs_needed(recall=0.999)


# --- 5 secrets --------------------------------------------------------------------------

NAIVE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def naive_secrets(t):
    out = []
    for k, p in NAIVE.items():
        for m in re.finditer(p, t or "", re.ASCII):
            if {"assign": k == "assign" and len(m[2]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[k]:
                out.append((m.start(), list(NAIVE).index(k), f"{k}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def test_secrets_against_naive_scan(spark, edges, nothing):
    rng = random.Random(6)
    parts = ["password=", "Token : '", "api_key", "=", "abc", "AKIA", "ABCDEFGHIJ1234567890", "0123456789abcdef" * 2, " ", "é", "\n", "secret:=x", "APIKEY='deadbeef01'", "pass"]
    rows = [(100 + n, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for n in range(200)] + EDGES
    got = secret_scan.secret_findings(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {i: t for i, t in rows}
    for r in got:
        spans = naive_secrets(by[r.key])
        assert r.base_spans == ",".join(spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in NAIVE)
        assert set(filter(None, r.base_spans.split(","))) <= set(filter(None, r.spans.split(",")))
    assert secret_scan.secret_findings(nothing).count() == 0


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = table(spark, [(1, "token=abcdef"), (2, "token=abcdef"), (3, "plain")])
    assert sorted(r.n_assign for r in secret_scan.secret_findings(first, path).collect()) == [0, 1, 1]
    assert spark.read.parquet(path).count() == 2
    later = table(spark, [(1, "token=abcdef"), (4, "passwd: 1234567"), (5, "plain"), (6, None)])
    assert {r.key: r.n_assign for r in secret_scan.secret_findings(later, path).collect()} == {1: 1, 4: 1, 5: 0, 6: 0}
    assert spark.read.parquet(path).count() == 4
    read = ledger.read(spark, path, secret_scan.LEDGER)
    assert read.select("digest").distinct().count() == 4


def test_redaction(spark, edges):
    docs = table(spark, [(1, "a token=abcdef b"), (2, "a token=abcdef b"), (3, "é password=0123456789abcdef0123456789abcdef!"), (4, None)])
    out = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(docs).collect()}
    assert out[1] == out[2] == ("a [SECRET] b", 12) and out[3][0] == "é [SECRET]!" and out[4][0] is None
    assert secret_scan.redact(edges).count() == len(EDGES)


def test_redaction_with_clashing_columns_and_repeated_ids(spark):
    docs = clashing(spark, [(1, "token=abcdef", "a"), (1, "nothing here", "b"), (None, "token=abcdef", "c"), (1, None, "d"), (2, "", "e")])
    out = {r["_key"]: r for r in secret_scan.redact(docs).collect()}
    assert {k: r.text for k, r in out.items()} == {"a": "[SECRET]", "b": "nothing here", "c": "[SECRET]", "d": None, "e": ""}
    assert out["a"]["_DIGEST"] == "d" and out["a"].n_chars == 8 and secret_scan.redact(docs).columns == docs.columns
    assert secret_scan.redact(docs.where("false")).count() == 0


def test_a_digest_that_is_appended_twice_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    docs = table(spark, [(1, "token=abcdef"), (2, "plain")])
    secret_scan.secret_findings(docs, path).collect()
    twice = spark.read.parquet(path).collect()
    spark.createDataFrame(twice, secret_scan.LEDGER).write.mode("append").parquet(path)
    assert secret_scan.secret_findings(docs, path).count() == 2


# --- 6 toxicity -------------------------------------------------------------------------


def toxic_corpus(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for n in range(600):
        w = [*words(rng, 40), "."] * 3
        bad = n % 6 == 0
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zarkonbrak", "zarkonist", "idiot"]))
        docs.append((n, " ".join(w)))
        labels.append((n, int(bad)))
    return table(spark, docs), spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 450 < kept.count() < 540


def test_labels_are_no_input(spark):
    docs, labels = toxic_corpus(spark)
    other = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, other)]
    assert scores[0] == scores[1]


def test_toxicity_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(edges, none).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(nothing, none).count() == 0


def every_path(symbols, start, f=toxicity.Factors()):
    """Factors of every path that all machines accept one after the other, without composing them."""
    chain = [(toxicity.negation(f.negated), ""), (toxicity.reported_speech(f.reported), start), (toxicity.threats(f.threat), ""), (toxicity.piled(f.piled), ""), (toxicity.targets(f.targeted, f.plain), "")]
    paths = [(list(symbols), [1.0] * len(symbols))]
    for machine, begin in chain:
        paths = [(out, [a * b for a, b in zip(f, g, strict=True)]) for read, f in paths for out, g in machine.outputs(read, begin)]
    return [f for _, f in paths]


def test_composed_machine_against_every_path():
    rng = random.Random(9)
    for n in range(400):
        factors = toxicity.Factors(*(rng.choice([0.3, 0.8, 1.0, 1.7]) for _ in range(6)))
        machine = toxicity.clause_grammar(factors)
        clause = [(rng.choice(toxicity.CLASSES), rng.choice([0.5, 1.0, 2.5])) for _ in range(rng.randint(0, 8))]
        read = [(c, x if c in toxicity.HOSTILE else 0.0) for c, x in clause]
        start = ("plain", "quoted")[n % 2]
        paths = every_path([c for c, _ in read], start, factors)
        wanted = max((sum(x * f for (_, x), f in zip(read, p, strict=True)) for p in paths), default=None)
        got = toxicity.matcher(factors).weight(read, start)
        assert got == pytest.approx(wanted) and wanted is not None
        composed = sorted(tuple(round(x, 9) for x in f) for _, f in machine.outputs([c for c, _ in read], start))
        assert composed == sorted(tuple(round(x, 9) for x in f) for f in paths)


def test_words_count_by_what_stands_around():
    g = toxicity.Grammar({})
    assert g.clauses("you idiot") == [pytest.approx(toxicity.PRIOR * toxicity.TARGETED)] and g.clauses("idiot of you") == g.clauses("you idiot")
    assert g.clauses("an idiot in a house of you") == [toxicity.PRIOR]
    assert g.clauses("not an idiot, never an idiot")[0] == pytest.approx(toxicity.PRIOR * toxicity.NEGATED)
    assert g.clauses("kill time") == [] and g.clauses("you kill") == [] and g.clauses("kill, you") == []
    assert g.clauses("they said kill them") == [pytest.approx(toxicity.THREAT * toxicity.REPORTED)]


def test_scores_of_whole_documents_by_every_path():
    rng = random.Random(12)
    pool = ["idiot", "zark", "kill", "you", "not", "said", "house", "runs"]
    classes = {"idiot": toxicity.INSULT, "zark": toxicity.INSULT, "kill": toxicity.THREATENING, "you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT}
    g = toxicity.Grammar({"zark$": toxicity.Arc(40, 1)}, 100, 100, (-3.0, 0.5, 0.9, -0.2), toxicity.Factors(0.6, 1.5, 1.2, 0.5, 0.8, 2.5))
    zark = math.log(40.5 / 101) - math.log(1.5 / 101) - 2 * math.sqrt(1 / 40.5 + 1 / 1.5)
    worth = {"idiot": toxicity.PRIOR, "zark": zark, "kill": 1.0}
    for _ in range(150):
        clauses = [[rng.choice(pool) for _ in range(rng.randint(1, 7))] for _ in range(rng.randint(0, 4))]
        best = [max(sum(worth.get(w, 0.0) * x for w, x in zip(c, path, strict=True)) for path in every_path([classes.get(w, toxicity.OTHER) for w in c], "plain", g.factors)) for c in clauses]
        hit = [b for b in best if b]
        z = -3.0 + 0.5 * max(hit, default=0) + 0.9 * math.log1p(sum(hit)) - 0.2 * math.log1p(len(hit))
        assert g.score(". ".join(" ".join(c) for c in clauses)) == pytest.approx(1 / (1 + math.exp(-z)))


def clauses_that_decide(spark):
    """Every document has the same insult; the labels follow from what stands around it."""
    rng = random.Random(13)
    rows, labels = [], []
    for n in range(900):
        bad = n % 3 == 0
        say = rng.choice(["you idiot", "idiot that you are", "an idiot idiot"]) if bad else rng.choice(["not an idiot", "never an idiot", "they said an idiot ran", "an idiot ran"])
        rows.append((n, f"{' '.join(words(rng, 12))}. {say}. they said you are not an {words(rng, 1)[0]} that never ran. {' '.join(words(rng, 12))}."))
        labels.append((n, int(bad)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_factors_are_learned_and_decide(spark):
    docs, labels = clauses_that_decide(spark)
    g = toxicity.learn(docs, labels.where(toxicity.remainder(F.col("doc_id"), 4) != 2))
    first = toxicity.Factors()
    assert g.factors.negated < first.negated and g.factors.targeted > first.targeted and g.factors.plain < first.plain and g.factors.piled > first.piled
    assert g.factors.threat == first.threat  # nothing here speaks for or against it
    held = [(r.toxic, r.predicted) for r in toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.95
    # the words alone cannot tell them apart: without factors equal insults weigh alike
    flat = toxicity.Grammar(g.arcs, g.n_toxic, g.n_clean, g.calibration, toxicity.Factors(1, 1, 1, 1, 1, 1))
    assert flat.score("not an idiot") == flat.score("you idiot") and g.score("not an idiot") < toxicity.THRESHOLD <= g.score("you idiot")


def test_grammar_of_clauses():
    g = toxicity.Grammar({})
    plain, denied, told = (sum(g.clauses(t)) for t in ("the clown ran.", "the man is not a clown.", "he said: what a clown."))
    assert plain > told > denied > 0
    assert sum(g.clauses("you idiot.")) > sum(g.clauses("the idiot."))
    assert g.clauses("they will kill time.") == [] and g.clauses("i will kill you.") != []
    assert len(g.clauses("idiot. fine. moron.")) == 2


# --- 7 token counts ----------------------------------------------------------------------


def test_token_counts_against_the_library(spark):
    """The library itself, not the operator's way of calling it."""
    import sentencepiece
    import tokenizers

    rows = EDGES + [(n, " ".join(words(random.Random(n), 40)) + " é\u3000x <s></s> <unk>\n") for n in range(20, 40)]
    piece = sentencepiece.SentencePieceProcessor(model_file=str(PIECE_BPE))
    whole = tokenizers.Tokenizer.from_file(str(WORD_BPE))
    whole.no_truncation()
    whole.no_padding()
    for path, count in ((PIECE_BPE, lambda t: len(piece.encode(t))), (WORD_BPE, lambda t: len(whole.encode(t, add_special_tokens=False).ids))):
        got = token_counts.token_counts(table(spark, rows), path).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, count(t or "")) for i, t in rows)


@pytest.mark.parametrize("path", [PIECE_BPE, WORD_BPE])
def test_token_counts(spark, edges, nothing, path, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = EDGES + [(11, "Ünï <s> </s> tokens  here"), (12, "Ünï <s> </s> tokens  here")]
    count = token_counts._encoder(path)
    for _ in range(2):
        got = token_counts.token_counts(table(spark, rows), path, cache).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or 0, len((t or "").encode()), count([t or ""])[0], count([t or ""])[0] > 4096) for i, t in rows)
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts.token_counts(nothing, path).count() == 0


# --- 8 licenses ---------------------------------------------------------------------------


def test_licenses(spark, edges, nothing):
    notice = license_scan.TEMPLATES["Apache-2.0/notice"]
    changed = notice.replace("required", "demanded").replace("ANY KIND", "SOME KIND")
    rows = [(1, f"x y z {license_scan.TEMPLATES['MIT/statement']} tail"), (2, f"a\n{changed}\nb"), (3, "nothing of the kind is written here at all"), (4, f"{notice}\n and again {notice}"), *EDGES]
    got = license_scan.license_spans(table(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == {1, 2, 4}
    assert [(r.license, r.coverage) for r in by[1]] == [("MIT/statement", 1.0)] and rows[0][1][by[1][0].start : by[1][0].stop] == "Released under the MIT License"
    (near,) = [r for r in by[2] if r.license == "Apache-2.0/notice"]
    assert 0.9 < near.coverage < 1 and rows[1][1][near.start : near.stop] == changed.rstrip(".")
    assert sum(r.license == "Apache-2.0/notice" for r in by[4]) == 2
    assert license_scan.license_spans(nothing).count() == 0
    many = license_scan.TEMPLATES | {f"t{n}": f"template number {n} says q{n} and no more" for n in range(2000)}
    assert {r.doc_id for r in license_scan.license_spans(table(spark, rows), many).collect()} == {1, 2, 4}


def test_license_lines_of_the_tables(spark):
    lines = {line for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for line in (t or "").split("\n") if re.search("licen[sc]e", line, re.I)}
    common_ones = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0/short", "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0/short", "SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0-or-later/spdx",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0/statement", "Released under the ISC License.": "ISC/statement",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0/statement", "SPDX-License-Identifier: MIT": "MIT/spdx",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0/statement",
    }
    rows = list(enumerate(sorted(lines | set(common_ones))))
    got = {(r.doc_id, r.license, r.coverage) for r in license_scan.license_spans(table(spark, [(n, f"Some words before\n{t}\nand after.") for n, t in rows])).collect()}
    assert lines and {i for i, _, _ in got} == {n for n, _ in rows}
    assert {(n, common_ones[t], 1.0) for n, t in rows if t in common_ones} <= got


def longest_chain(template, doc, band):
    """Most equal words in order in both whose diagonals are within ``band`` of a common one, by all chains of equal pairs."""
    pairs = [(i, j) for i, w in enumerate(template) for j, x in enumerate(doc) if w == x]
    best = 0
    for d in range(-len(template), len(doc)):
        near = [(i, j) for i, j in pairs if abs(j - i - d) <= band]
        length = []
        for i, j in near:
            length.append(1 + max((n for n, (x, y) in zip(length, near) if x < i and y < j), default=0))
        best = max([best, *length])
    return best


def test_winnowed_fingerprints():
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 7, 40, 200):
        h = rng.integers(0, 30, size).astype(np.uint64)
        for window in (1, 2, 4, 9):
            places = license_scan.winnowed(h, window).tolist()
            width = min(window, size)
            naive = {max(range(a, a + width), key=lambda x: (-int(h[x]), x)) for a in range(size - width + 1)}
            assert places == sorted(naive)
    index = license_scan._Index(license_scan.TEMPLATES)
    # far fewer keys than words, and no place can be without all of its fingerprints
    assert len(index.keys) < 0.7 * len(np.unique(np.concatenate(index.words))) and (index.hits >= 1).all()


def test_templates_beyond_the_bound(spark):
    with pytest.raises(ValueError):
        license_scan.license_spans(table(spark, EDGES), {"t": "word " * (license_scan.TEMPLATE_BYTES // 5 + 1)})


def test_edited_licenses_against_brute_force():
    rng = random.Random(8)
    templates = {f"t{n}": " ".join(words(rng, size, "abc"[n % 3])) for n, size in enumerate((1, 2, 4, 5, 6, 8, 10, 15, 23, 40))} | {"MIT": license_scan.TEMPLATES["MIT/statement"], "the": "the law of the land and the rule of the house"}
    index = license_scan._Index(templates)
    reported = missed = 0
    for n in range(400):
        name = rng.choice(sorted(templates))
        w = templates[name].lower().rstrip(".").split()
        band = max(1, min(16, len(w) // 4))
        for _ in range(rng.randint(0, len(w) // 5 + 1)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], ["other"], [w[at], "more"]))
        doc = common.word_hashes(" ".join(words(rng, 9, "x") + w + words(rng, 9, "y")))[0]
        template = common.word_hashes(templates[name])[0].tolist()
        best = longest_chain(template, doc.tolist(), band)
        got = [m for m in license_scan.matches(doc, index) if m[0] == name]
        wanted = best / len(template) >= license_scan.COVERAGE
        assert bool(got) == wanted and (not wanted or max(m[2] for m in got) == best)
        reported += wanted
        missed += not wanted
    assert reported > 100 and missed > 50
    for edited in ("Released below the MIT License.", "Released under the XYZ License.", "Released under a MIT License."):
        (m,) = [m for m in license_scan.matches(common.word_hashes(edited)[0], index) if m[0] == "MIT"]
        assert m[1:3] == (0.8, 4)


# --- 9 fingerprints ------------------------------------------------------------------------


def naive_fingerprint(text):
    (_, h, s, e), = common.hashed([text])
    keys = order_minhash._kmers(h, s, e, text)
    out = []
    for j, a in enumerate(order_minhash._multipliers()):
        value = [(int(x) >> 32) * int(a) & 0xFFFFFFFF for x in keys]
        picked = sorted(sorted(range(len(keys)), key=lambda i: (value[i], i))[: order_minhash.L])
        mixed = np.array([j], np.uint64)
        for x in [0] * (order_minhash.L - len(picked)) + [int(keys[i]) for i in picked]:
            mixed = common.mix(mixed ^ np.uint64(x))
        out.append(int(mixed.astype(np.uint32)[0]))
    return out


def test_fingerprints_against_naive(spark):
    rng = random.Random(9)
    texts = ["", "one", "one two", "a a a a a a", " ".join(words(rng, 300)), " ".join(rng.choice("ab") for _ in range(80)), "x, y;  z"]
    assert order_minhash.fingerprints(texts).tolist() == [naive_fingerprint(t) for t in texts]


def test_edits_and_neighbours(spark, nothing):
    rng = random.Random(10)
    rows = [(n * 3, " ".join(words(rng, rng.randint(0, 120)))) for n in range(50)] + [(5, "twice"), (5, "twice"), (7, None)]
    rng.shuffle(rows)
    got = sorted(order_minhash.edit_sensitivity(table(spark, rows)).collect(), key=lambda r: r.doc_id)
    ordered = sorted((i, t or "") for i, t in rows)
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    prints = {t: p for t, p in zip([t for _, t in ordered], order_minhash.fingerprints([t for _, t in ordered]), strict=True)}
    for n, r in enumerate(got):
        text, following = ordered[n][1], ordered[(n + 1) % len(ordered)][1]
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own = order_minhash.fingerprints([changed])[0]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), order_minhash._hex(prints[text]))
        assert r.near_edited == (prints[text] == own).mean() and r.near_next == (prints[text] == prints[following]).mean()
    assert order_minhash.edit_sensitivity(nothing).count() == 0
    (alone,) = order_minhash.edit_sensitivity(table(spark, [(None, "abcd")])).collect()
    assert (alone.doc_id, alone.near_next) == (None, 1.0)


def test_order_matters():
    rng = random.Random(11)
    w = words(rng, 200)
    a, moved = " ".join(w), " ".join(w[100:] + w[:100])
    x, y = order_minhash.fingerprints([a, moved])
    assert (x == y).mean() < 0.75


# --- 10 repeated paragraphs -------------------------------------------------------------------


def naive_paragraphs(text):
    """(first word, word after) of each paragraph, by looking at all neighbours of each word."""
    h, _, _ = common.word_hashes(text)
    x, n, reach = [int(v) | 1 for v in common.shingles(h, 2)], len(h), substring_dedup.REACH
    cuts = [i for i in range(reach, n - 1 - reach) if all(x[i] < x[j] for j in range(i - reach, i)) and all(x[i] <= x[j] for j in range(i + 1, i + reach + 1))]
    return list(zip([0, *cuts], [*cuts, n], strict=True)) if n else []


def naive_repeats(rows, inside, least):
    """(row, paragraph) -> (first place of the group, span) of all paragraphs that repeat, comparing all pairs."""
    units = [(r, p, re.findall(r"[^\W_]+", t.lower())[a:b]) for r, (_, t) in enumerate(rows) if t for p, (a, b) in enumerate(naive_paragraphs(t))]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for _, _, w in units]
    group = list(range(len(units)))
    for a, b in combinations(range(len(units)), 2):
        if group[a] != group[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            group = [group[a] if g == group[b] else g for g in group]
    places = defaultdict(list)
    for g, (r, p, w) in zip(group, units, strict=True):
        places[g].append((r, p, len(w)))
    found = {(r, p): (n, min(((-1 if rows[x][0] is None else rows[x][0]), x, q) for x, q, _ in own)) for own in places.values() if len({x[: 2 if inside else 1] for x in own}) > 1 for r, p, n in own}
    out = {}
    for r, p in found:
        low, high = p, p
        while (r, low - 1) in found:
            low -= 1
        while (r, high + 1) in found:
            high += 1
        size = sum(found[r, q][0] for q in range(low, high + 1))
        if size >= least:
            out[r, p] = (found[r, p][1], size)
    return out


@pytest.mark.parametrize("inside", [False, True])
def test_paragraphs_against_brute_force(spark, inside):
    rng = random.Random(12)
    shared = [words(rng, n) for n in (55, 70, 90, 130)]
    rows = []
    for n in range(40):
        w = words(rng, rng.randint(3, 160))
        if n % 2:
            own = list(shared[n // 2 % 4])
            if n % 3 == 0:
                own[5] = f"edit{n}"
            at = rng.randrange(len(w))
            w[at:at] = own
        rows.append((n, "".join(rng.choice([" ", "\n", ", "]) + x for x in w)))
    own = " ".join(words(rng, 150))
    rows += [(40, f"{own} some other words {own}"), (7, rows[7][1]), (7, rows[9][1]), (None, rows[5][1]), (41, "same " * 90), (42, "same " * 99), (43, None), (44, ""), (45, "three short words"), (46, "three short words")]
    wanted = naive_repeats(rows, inside, substring_dedup.LEAST_WORDS)
    got = substring_dedup.repeated_paragraphs(table(spark, rows), inside=inside).collect()
    name = lambda lead: ":".join(str(x) for x in (lead[0], lead[2]) if x != -1)
    assert Counter((r.doc_id, r.paragraph, r.group_id, r.span_words) for r in got) == Counter((rows[r][0], p, name(lead), size) for (r, p), (lead, size) in wanted.items())
    leads = {lead[1:] for lead, _ in wanted.values()}
    assert sum(r.keep for r in got) == len(leads & set(wanted))
    texts = dict(rows[:40])
    for r in got:
        if r.doc_id in texts and r.doc_id != 7:
            assert len(re.findall(r"\w+", texts[r.doc_id][r.start : r.stop])) == r.n_words and r.span_start <= r.start < r.stop <= r.span_stop
    assert (40 in {r.doc_id for r in got}) == inside and {41, 42, 7, None} <= {r.doc_id for r in got} and not {43, 44, 45, 46} & {r.doc_id for r in got}
    left = substring_dedup.removed(table(spark, rows), inside=inside)
    assert left.count() == len(rows) and left.columns == table(spark, rows).columns


def test_passages_of_fifty_words_are_caught(spark):
    """Each document that shares 51 words in a row with another one has a repeated paragraph, but for a few."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, re.findall(r"[^\W_]+", (r.text or "").lower())) for r in docs.collect()]
    held = defaultdict(set)
    for i, w in rows:
        for j in range(len(w) - 50):
            held[tuple(w[j : j + 51])].add(i)
    wanted = set().union(*(x for x in held.values() if len(x) > 1))
    got = {r.doc_id for r in substring_dedup.repeated_paragraphs(docs).collect()}
    assert len(wanted) > 20 and len(wanted & got) >= 0.95 * len(wanted)
    assert len(got - wanted) <= 0.1 * (len(rows) - len(wanted))


def test_removed_keeps_rows_that_share_an_id_apart(spark):
    rng = random.Random(2)
    long, other = " ".join(words(rng, 80)), " ".join(words(rng, 80))
    schema = "doc_id long, text string, _key string, _CUT string, row long, node long"
    docs = spark.createDataFrame([(1, long, "a", "b", 5, 6), (2, long, "c", "d", 5, 6), (2, other, "e", "f", 5, 6), (3, None, "g", "h", 5, 6)], schema)
    left = {r["_key"]: r for r in substring_dedup.removed(docs).collect()}
    assert {k: r.text for k, r in left.items()} == {"a": long, "c": "", "e": other, "g": None} and left["c"]["_CUT"] == "d"


def test_paragraph_edges(spark, edges, nothing):
    assert substring_dedup.repeated_paragraphs(edges).count() == 0
    assert [r.doc_id for r in substring_dedup.repeated_paragraphs(edges, inside=True).collect()] == []
    assert substring_dedup.repeated_paragraphs(nothing).count() == 0
    assert substring_dedup.removed(edges).columns == edges.columns and substring_dedup.removed(nothing).count() == 0


def test_bands_reach_the_recall():
    bands, rows = substring_dedup.tune_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= substring_dedup.RECALL and bands * rows <= substring_dedup.MOST_MINIMA


# --- 10 repeated passages ---------------------------------------------------------------------


def test_passages_against_brute_force(spark):
    rng = random.Random(13)
    shared = [words(rng, n) for n in (50, 51, 56, 60, 90, 49)]
    rows = []
    for n in range(48):
        w = words(rng, rng.randint(20, 200))
        at = rng.randrange(len(w))
        cut = rng.randrange(len(shared[4]) - 55)
        own = shared[4][cut : cut + rng.randint(50, 55)] if n % 6 == 4 else shared[n % 6]
        w[at:at] = own  # inside a longer line
        breaks = {at + 5, at + 14, at + 23} if n % 4 == 1 else {at + 3 + 10 * k for k in range(6)} if n % 4 == 3 else set()
        rows.append((n, "".join(("\n" if k in breaks else ", ") + x for k, x in enumerate(w))))
    rows += [(48, rows[0][1].upper()), (49, " ".join(shared[2] + words(rng, 7) + shared[2])), (50, "same " * 120), (7, rows[7][1]), *EDGES[:4], (None, rows[3][1])]
    rows += [(60, " ".join(words(rng, 80)))]
    docs = [re.findall(r"\w+", (t or "").lower()) for _, t in rows]
    places = defaultdict(list)
    for r, w in enumerate(docs):
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].append((r, k))
    key = lambda i: -1 if i is None else i
    wanted = {(rows[r][0], j, min((key(rows[a][0]), b) for a, b in x)) for x in places.values() if len(x) > 1 for r, k in x for j in [k]}
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.word + k, (key(r.source_doc), r.source_word + k)) for r in got for k in range(r.n_words - 49)} == wanted
    texts = {i: t for i, t in rows if i is None or i > 4}
    for r in got:
        assert r.keep == (r.source_doc == r.doc_id and r.source_word == r.word)
        if r.doc_id in texts:
            assert len(re.findall(r"\w+", texts[r.doc_id][r.start : r.stop])) == r.n_words
    assert {1, 3, 48, 49, 50, None} <= {r.doc_id for r in got} and 60 not in {r.doc_id for r in got}


def test_passages_of_rows_that_share_an_id(spark):
    text = " ".join(words(random.Random(14), 60))
    got = passages.repeated_passages(table(spark, [(1, text), (2, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.word, r.n_words, r.keep) for r in got) == [(1, 0, 60, True), (2, 0, 60, False), (2, 0, 60, False)]


def test_passage_edges(spark, edges, nothing):
    (long,) = {r.doc_id for r in passages.repeated_passages(edges).collect()}
    assert long == 8 and passages.repeated_passages(nothing).count() == 0


def test_windows_of_one_very_long_text():
    """A text of a million tokens beside short ones: memory follows the tokens, not the longest lane times all lanes."""
    import tracemalloc

    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 500, 1_000_000).astype(np.int32)] + [rng.integers(0, 500, 50).astype(np.int32) for _ in range(600)]
    tracemalloc.start()
    seen, starts = np.zeros(len(docs), np.int64), 0
    for inputs, target, resets, owner in language_model._windows(docs, 777):
        real = target >= 0
        seen += np.bincount(owner[real], minlength=len(docs))
        starts += int((inputs[real] == 777).sum())
        assert inputs.shape == target.shape == owner.shape and len(resets) == len(target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.tolist() == [len(d) for d in docs] and starts == len(docs) and peak < 100e6


def test_windows_against_a_loop():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 90, n).astype(np.int32) for n in rng.integers(1, 200, 700)]
    got = defaultdict(list)
    for inputs, target, resets, owner in language_model._windows(docs, 99):
        for t in range(len(target)):
            assert resets[t].tolist() == [n for n in range(target.shape[1]) if target[t, n] >= 0 and inputs[t, n] == 99]
            for n in range(target.shape[1]):
                if target[t, n] >= 0:
                    got[owner[t, n]].append((inputs[t, n], target[t, n]))
    assert got == {d: list(zip([99, *x[:-1].tolist()], x.tolist(), strict=True)) for d, x in enumerate(docs)}


def test_dictionary_is_filled_to_its_size(spark):
    rng = random.Random(9)
    words_ = {f"w{n}".encode(): rng.choice((1, 1, 1, 1, 2, 3, 40, 41, 42)) for n in range(3000)}
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in words_.items()], "word binary, n long")
    wanted = sorted(words_.items(), key=lambda x: (-x[1], x[0]))
    for most in (1, 10, 500, 1200, 2999, 3000, 5000):
        assert language_model._frequent(counts, most) == wanted[:most]
    once = spark.createDataFrame([(bytearray(f"v{n}".encode()), 1) for n in range(70_000)] + [(bytearray(b"end"), 5)], "word binary, n long")
    assert len(language_model._frequent(once, 65_536)) == 65_536
