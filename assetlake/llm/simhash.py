"""SimHash near-duplicates: pigeonhole blocks, joined on their bits, verified by Hamming distance.

A fingerprint is the majority of the bits of its text's shingles. Equal
fingerprints are one node, however many documents have them. The 64 bits are
dealt into four blocks; fingerprints that differ in at most two bits agree in
at least two of the blocks, so each has six keys (two blocks' places and bits)
and meets its links under one of them. A key with more than ``BUCKET``
fingerprints is split by the same rule: its members agree in the key's bits, so
the free ones alone are dealt into four blocks again (48, then 56 fixed bits in
all). The last keys leave eight free bits, hence 256 fingerprints at most, and
nothing is capped. A bucket gives a spanning forest of its links, never pairs.

Defined cases: null and empty texts and those without a word have fingerprint
zero, which links like any other; repeated rows come back each; rows with a null
id are documents, but name no component (one of only such rows has none); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, links

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
DISTANCE = 2
BLOCKS = 4
#: Fingerprints of one key that are compared in one place.
BUCKET = 2048
#: Fixed bits of the keys, level by level.
LEVELS = (32, 48, 56)
#: Shingles hashed at a time.
_MOST = 1 << 16

# ASCII capitals to small letters, ASCII blanks to spaces
_PLAIN = bytes(32 if n == 32 or 9 <= n <= 13 else n + 32 if 65 <= n <= 90 else n for n in range(256))


def _words(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and the place where each begins and ends."""
    raw = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    codes = np.frombuffer(raw, np.uint8)
    blank = codes == 32
    if blank.any():
        spare = blank.copy()
        spare[1:] &= blank[:-1]  # blanks after a blank
        codes = codes[~spare]
        raw = codes.tobytes().strip(b" ")
        codes = np.frombuffer(raw, np.uint8)
    if not raw:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(codes == 32)
    return raw, np.concatenate([[0], gaps + 1]), np.append(gaps, len(raw))


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of a text."""
    raw, starts, ends = _words(text)
    if not len(starts):
        return 0
    if len(starts) < SHINGLE:
        return xxhash.xxh64_intdigest(raw, SEED)
    starts, ends = starts[: len(starts) - SHINGLE + 1], ends[SHINGLE - 1 :]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), _MOST):
        spans = zip(starts[at : at + _MOST].tolist(), ends[at : at + _MOST].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprint_rows(batches):
    for batch in common.slices(batches):
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "node": pa.array(values.view(np.int64), pa.int64())})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, node): the fingerprint of each document as a signed long."""
    return common.texts_of(docs).mapInArrow(_fingerprint_rows, "doc_id long, node long")


def block_keys(h: np.ndarray, fixed: int, held: np.ndarray | None = None) -> np.ndarray:
    """(n, 6) masks of the bits that the keys of ``fixed`` bits hold, for each of the fingerprints ``h``.

    ``held``: the mask of each one's key above, whose bits stay in all the keys below it.
    """
    held = np.zeros(len(h), np.uint64) if held is None else held
    free = np.unpackbits((~held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    place = np.cumsum(free, axis=1) - 1  # of a free bit among the free ones
    block = place * BLOCKS // np.maximum(free.sum(axis=1, keepdims=True), 1)
    out = []
    for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE):
        bits = ~free | np.isin(block, chosen)
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0])
    masks = np.stack(out, axis=1) if len(h) else np.zeros((0, 6), np.uint64)
    if len(h) and (np.bitwise_count(masks) != fixed).any():
        raise ValueError("a key holds another number of bits than its level")
    return masks


def _key_rows(fixed: int):
    def run(batches):
        for batch in batches:
            h = batch.column("node").to_numpy().view(np.uint64)
            held = batch.column("mask").to_numpy().view(np.uint64)
            masks = block_keys(h, fixed, held)
            n = masks.shape[1]
            mask, node = masks.ravel(), np.repeat(h, n)
            yield pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64), pa.int64()) for k, v in (("node", node), ("mask", mask), ("bits", node & mask))})

    return run


def _forest(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) with the same components as all links between the fingerprints ``h``."""
    near = np.bitwise_count(h[:, None] ^ h[None, :]) <= DISTANCE
    label = links._joined(len(h), *np.nonzero(np.triu(near, 1)))
    moved = np.flatnonzero(label != np.arange(len(h)))
    return h[moved], h[label[moved]]


def _bucket_links(batches):
    """(a, b) of the buckets of rows (mask, bits, node), sorted by key; a bucket that goes on in the next batch waits for it."""
    held = None
    for batch in chain(batches, [None]):
        now = np.stack([batch.column(c).to_numpy() for c in ("mask", "bits", "node")]) if batch is not None else np.zeros((3, 0), np.int64)
        rows = now if held is None else np.concatenate([held, now], axis=1)
        edge = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
        done = rows.shape[1] if batch is None else int(edge[-1]) if len(edge) else 0
        held, rows, edge = rows[:, done:], rows[:, :done], edge[edge < done]
        left, right = [], []
        cuts = np.concatenate([[0], edge, [done]]).astype(int)
        for n in np.flatnonzero(np.diff(cuts) > 1):
            a, b = _forest(rows[2, cuts[n] : cuts[n + 1]].view(np.uint64))
            left.append(a)
            right.append(b)
        if left:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(left).view(np.int64)), "b": pa.array(np.concatenate(right).view(np.int64))})


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between the fingerprints ``nodes`` (node, no repeats) with the same components as all links within ``DISTANCE`` bits."""
    spark = nodes.sparkSession
    common.bounded_batches(spark)
    todo, found = nodes.select("node", F.lit(0).cast("long").alias("mask")), None
    for fixed in LEVELS:
        keyed = common.materialize(todo.mapInArrow(_key_rows(fixed), "node long, mask long, bits long"), "simhash-keys")
        if fixed == LEVELS[-1]:
            few = keyed
        else:
            heavy = common.materialize(keyed.groupBy("mask", "bits").count().where(F.col("count") > bucket).select("mask", "bits"), "simhash-heavy")
            last = heavy.isEmpty()
            few = keyed if last else keyed.join(common.small(heavy), ["mask", "bits"], "left_anti")
        met = few.repartition(common.tasks(spark), "mask", "bits").sortWithinPartitions("mask", "bits")
        part = common.materialize(met.mapInArrow(_bucket_links, "a long, b long").distinct(), "simhash-links")
        found = part if found is None else found.unionByName(part)
        if fixed == LEVELS[-1] or last:
            return found
        todo = keyed.join(common.small(heavy), ["mask", "bits"], "left_semi").select("node", "mask")
    raise AssertionError("the last level returns")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document; a component is named by its least doc_id."""
    prints = common.materialize(fingerprints(docs), "simhash")
    nodes = common.materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    joined = links.components(near_links(nodes), "simhash-components")
    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = common.materialize(named.select("node", "component", "least"), "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = common.materialize(named.join(common.small(least), "component").select("node", "component_id"), "simhash-ids")
    for table in (nodes, named):
        common.discard(table)
    fingerprint_hex = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return prints.join(common.small(ids), "node").select("doc_id", fingerprint_hex.alias("fingerprint"), "component_id")
