"""N-gram Jaccard self-join by chosen paths.

Each document is the set of its five-word shingles. Equal word sequences form
one class at once, so a class needs one set whatever its number of copies. The
join is about pairs of classes with a Jaccard similarity of 0.8 or more.

Chosen paths: a set is embedded as ``TOKENS`` min-wise tokens, of which two sets
share a part equal to their similarity. A run starts with all sets in one
bucket and splits buckets recursively: each bucket (path) samples tokens, each
with the chance ``1 / (SIMILARITY * TOKENS)``, and a set goes on to the child of
every sampled token with the token's value, so that a pair at the threshold is
expected to stay together in one child at each level, while dissimilar sets part.
A bucket of up to ``BRUTE_FORCE`` sets is searched by brute force over the
embedded sets; others are split further, down to ``DEPTH``. A bucket that is
still large then holds near copies; it is not searched but taken as one
candidate group. Runs repeat, with other samples, until the expected recall of a
pair at the threshold reaches ``RECALL``; ``runs_needed`` computes their number
by the recursion for the survival of a pair.

Candidate pairs and large buckets join into candidate groups (connected
components), and inside each group all pairs are compared exactly, by tiles
(``links.exact_links``); a link between two members of a group is thus never
lost, even if no run had put the two together.

Defined cases: texts of one to four words are one shingle of all their words;
texts without any word (null, empty) link to nothing and are classes of their
own; rows of equal words are copies; repeated rows count as copies and get a row
each; rows with a null id take part but cannot stand for a class if another can;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, links
from .common import SIMILARITY

TOKENS = 64
DEPTH = 3
BRUTE_FORCE = 48
RECALL = 0.999
#: Share of equal tokens from which a pair of a small bucket is a candidate: four standard errors under the threshold.
CANDIDATE = 0.6


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, levels: int = 3) -> int:
    """Runs until a pair of the given similarity has met with probability ``recall``, if buckets are small after ``levels``.

    A bucket samples Binomial(TOKENS, 1 / (SIMILARITY * TOKENS)) tokens and the
    pair survives in one with the chance ``similarity``; met(l) is the chance to
    be together in some bucket after l levels.
    """
    p = similarity / (SIMILARITY * TOKENS)
    met = 1.0
    for _ in range(levels):
        met = 1 - (1 - p * met) ** TOKENS
    return int(np.ceil(np.log(1 - recall) / np.log(1 - met)))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(4).integers(1 << 31, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)


def _embed(batches):
    """(row, doc_id, words, tokens, prints): hash of the word sequence, the min-wise tokens, and a byte of each; nulls for no words."""
    a = _multipliers()
    for batch in common.batches(batches):
        n = len(batch["doc_id"])
        words, tokens, prints = [None] * n, [None] * n, [None] * n
        held, sets = [], []
        for i, h, _, _ in common.hashed(batch["text"]):
            if len(h):
                held.append(i)
                words[i] = common.whole_hash(h)
                sets.append((common.shingles(h, min(len(h), common.SHINGLE_WORDS)) >> np.uint64(32)).astype(np.uint32))
        if held:
            first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
            every, low = np.concatenate(sets), np.empty((len(held), TOKENS), np.uint32)
            for j in range(TOKENS):
                with np.errstate(over="ignore"):
                    low[:, j] = np.minimum.reduceat(every * a[j], first)
            marks = (common.mix(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            for k, i in enumerate(held):
                tokens[i], prints[i] = low[k].tobytes(), marks[k].tobytes()
        yield pa.RecordBatch.from_pydict(
            {"row": pa.array(batch["row"], pa.int64()), "doc_id": pa.array(batch["doc_id"], pa.int64()), "words": pa.array(words, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "prints": pa.array(prints, pa.binary())}
        )


def _split(node: np.ndarray, path: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that each set goes on to: (node, path) for every token that its bucket samples."""
    limit = np.uint64(int((1 << 64) / (SIMILARITY * TOKENS)))
    nodes, paths = [], []
    for j in range(TOKENS):
        own = np.flatnonzero(common.mix(path, 100 + j) < limit)
        nodes.append(node[own])
        paths.append(common.mix(common.mix(path[own], 2) ^ (grid[own, j].astype(np.uint64) << np.uint64(8)) ^ np.uint64(j), 3))
    return np.concatenate(nodes), np.concatenate(paths)


def _children(runs: int | None):
    """Task function: the next level of (node, path, tokens), or of all roots of ``runs`` for (node, tokens)."""

    def split(batches):
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            grid = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            if runs is None:
                levels = [batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)]
            else:
                levels = [np.full(len(node), r, np.uint64) for r in range(runs)]
            for path in levels:
                nodes, paths = _split(node, path, grid)
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "path": pa.array(paths.view(np.int64), pa.int64())})

    return split


def _brute_force(batches):
    """Edges that connect the similar sets of each small bucket, from rows (path, node, prints) sorted by path."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        path = rows.column("path").to_numpy()
        open_from = int(np.searchsorted(path, path[-1])) if len(path) else 0
        rest = rows.slice(open_from)
        yield from _bucket_edges(rows.slice(0, open_from))
    if rest is not None:
        yield from _bucket_edges(rest)


def _bucket_edges(rows: pa.Table):
    if rows.num_rows < 2:
        return
    path, node = rows.column("path").to_numpy(), rows.column("node").to_numpy()
    grid = np.frombuffer(b"".join(rows.column("prints").to_pylist()), np.uint8).reshape(-1, TOKENS)
    left, right = [], []
    for shift in range(1, len(path)):
        at = np.flatnonzero(path[shift:] == path[:-shift])
        if not len(at):
            break
        at = at[(grid[at] == grid[at + shift]).mean(axis=1) >= CANDIDATE]
        left.append(at)
        right.append(at + shift)
    if not left:
        return
    left, right = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(path))
    while True:
        low = label.copy()
        np.minimum.at(low, right, label[left])
        np.minimum.at(low, left, label[right])
        if (low == label).all():
            break
        label = low
    own = np.flatnonzero(label != np.arange(len(path)))
    yield pa.RecordBatch.from_pydict({"a": pa.array(node[own], pa.int64()), "b": pa.array(node[label[own]], pa.int64())})


def _sets(batches):
    """(node, set) of each text."""
    for batch in common.batches(batches):
        nodes, sets = [], []
        for _, h, _, _ in common.hashed(batch["text"]):
            if len(h):
                nodes.append(common.whole_hash(h))
                sets.append(common.similar_set(h).view(np.int64))
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "set": pa.array(sets, pa.list_(pa.int64()))})


def _candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that may be similar, by the runs over ``classes`` (node, tokens, prints)."""
    found = []
    rows = classes.select("node", "tokens").mapInArrow(_children(runs_needed(recall=RECALL)), "node long, path long")
    for level in range(1, DEPTH + 1):
        rows = common.materialize(rows, "paths")
        size = common.materialize(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"), "buckets")
        sized = common.materialize(rows.join(common.small(size), "path"), "sized-paths")
        few = sized.where(F.col("n") <= BRUTE_FORCE).select("node", "path").join(classes.select("node", "prints"), "node")
        few = few.select("path", "node", "prints").repartition(common.tasks(rows.sparkSession), "path").sortWithinPartitions("path")
        found.append(common.materialize(few.mapInArrow(_brute_force, "a long, b long").distinct(), "candidates"))
        many = sized.where(F.col("n") > BRUTE_FORCE)
        if level == DEPTH:
            found.append(many.select(F.col("node").alias("a"), F.col("least").alias("b")).where("a != b").distinct())
        elif many.isEmpty():
            break
        else:
            rows = many.select("node", "path").join(classes.select("node", "tokens"), "node").mapInArrow(_children(None), "node long, path long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _similar_rows(texts: DataFrame) -> DataFrame:
    """(row, doc_id, grp, class_id, n_links, n_copies) of each row (row, doc_id, text); ``grp`` names its group, null for no words."""
    rows = common.materialize(texts.select("row", "doc_id", "text").mapInArrow(_embed, "row long, doc_id long, words long, tokens binary, prints binary"), "embedded")
    classes = rows.where("words is not null").groupBy(F.col("words").alias("node")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.first("tokens").alias("tokens"), F.first("prints").alias("prints"))
    classes = common.materialize(classes, "classes")
    groups = common.materialize(links.components(_candidates(classes), "candidate-groups"), "candidate-groups")
    members = common.materialize(classes.select("node", "first", "weight").join(groups, "node"), "members")
    chosen = common.materialize(members.select(F.col("first").alias("doc_id")).distinct(), "member-ids")
    # a null id cannot be joined; such rows are read as they are
    own = texts.join(common.small(chosen, 16), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    sets = own.select("text").mapInArrow(_sets, "node long, set array<long>").join(common.small(members.select("node", "weight", F.col("component").alias("grp"))), "node")
    sets = sets.dropDuplicates(["node"]) if _has_repeats(rows) else sets
    counts, forest = links.exact_links(common.materialize(sets.select("grp", "node", "weight", "set"), "sets"))
    joined = common.materialize(links.components(forest, "groups"), "groups")
    table = classes.select("node", "first", "weight").join(joined, "node", "left").join(counts, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    table = common.materialize(table, "class-table")
    least = table.where("grp != node or links > 0").groupBy("grp").agg(F.min("first").alias("least"))
    table = table.join(least, "grp", "left").select(F.col("node").alias("words"), "grp", F.coalesce("least", "first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("weight") - 1).alias("n_copies"))
    table = common.materialize(table, "class-rows")
    zero = F.lit(0).cast("long")
    joined = rows.select("row", "doc_id", "words").join(table, "words", "left")
    return joined.select("row", "doc_id", "grp", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for each row.

    ``class_id``: the least doc_id of the group of documents that are connected
    by copies and links; ``n_links``: classes of other words that are linked to
    the row's own; ``n_copies``: other rows with the same words.
    """
    return _similar_rows(common.texts_of(docs).withColumn("row", F.lit(0).cast("long"))).drop("row", "grp")


def _has_repeats(rows: DataFrame) -> bool:
    """Whether an id, or a missing one, occurs in several rows."""
    return not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without copies and near copies: of each group one row stays, with all its columns.

    It is the row with the least id; of rows that share it (or have none, if all
    have none) the first as they were written down. Rows without a word stay. A
    key of its own tells rows apart, so an id that stands in several rows loses
    only those that copy something.
    """
    keyed, key = common.with_key(docs, "keyed-documents")
    texts = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = common.materialize(_similar_rows(texts).where("grp is not null"), "similar")
    first = table.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = common.materialize(table.join(first, "grp").where("row != first.row").select(F.col("row").alias(key)), "near-copies")
    return keyed.join(common.small(gone, 16), key, "left_anti").select(docs.columns)
