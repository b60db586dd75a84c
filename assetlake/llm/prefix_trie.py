"""Prefix trie of conversations as a z-fast trie in tables.

A path is the sequence of a conversation's turns; the hash of each of its
prefixes is a sum of the turns' digests times powers of an odd base (two lanes
of 64 bits). A compacted node stands for the depths (lo, hi] of the paths
through it, between one branching or ending depth and the next. The trie is a
table of such nodes, keyed by their handles: the hash of the prefix at the
two-fattest depth of (lo, hi], the one divisible by the greatest power of two.

Distinct paths are inserted in batches. A batch finds its exit nodes by fat binary
search, one join on handles for each of the logarithmically many steps; the
edge on which a path exits is split where the two part, and the turns beyond are
compacted into new nodes, all as joins and aggregates over rows. At last the
edges are expanded into one row for each depth. No conversation, node or edge is ever
gathered: turns are numbered by ranges of (conv_id, turn), so one
that holds most of the rows is spread over tasks.

Order: by turn (null first), then role, then the MD5 of role and text. Defined
cases: null roles and texts are empty; rows without a conv_id are left out;
repeated rows are turns of their own; extra columns are ignored; an empty table
has no nodes, not even the root. Hashes are compared, not texts: two of n
different prefixes are taken for one with a chance of about n² / 2¹²⁹.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Cumulated shares (in 64ths) of the paths that the batches bring.
BATCHES = (1, 8, 64)
#: Turns at most that a conversation takes from the one it shares, less one.
SHARED = 6
#: Hash of the empty prefix.
NONE = bytes(16)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_ALL = (1 << 64) - 1


# --- prefixes of ordered turns -----------------------------------------------------


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """``base`` to the powers ``n``, negative ones too, modulo 2 ** 64 (an odd base has an inverse)."""
    out, left = np.ones(len(n), np.uint64), np.abs(n)
    up, down = base, pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        while left.any():
            odd = (left & 1).astype(bool)
            out[odd] *= np.where(n[odd] < 0, np.uint64(down), np.uint64(up))
            up, down, left = up * up & _ALL, down * down & _ALL, left >> 1
    return out


def _digests(column: pa.Array) -> np.ndarray:
    """(n, 2) lanes of a column of 16 bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _binary(lanes: np.ndarray) -> pa.Array:
    """The inverse of ``_digests``."""
    offsets = np.arange(0, 16 * len(lanes) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lanes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lanes, "<u8").tobytes())])


_LOCAL = "conv_id long, part int, at long, chars long, upto long, term binary, total binary"


def _local_rows(batches):
    """Numbers, terms and running totals within one task's part of a conversation; rows come in order."""
    part, of, n, upto, total = TaskContext.get().partitionId(), None, 0, 0, np.zeros(2, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, chars = batch.column("conv_id").to_numpy(), batch.column("chars").to_numpy()
        new = np.concatenate([[ids[0] != of], ids[1:] != ids[:-1]])
        index = np.arange(len(ids))
        begin = np.maximum.accumulate(np.where(new, index, 0))
        mine = np.cumsum(new) == 0  # rows that go on with the conversation of the batch before
        at = index - begin + 1 + n * mine
        with np.errstate(over="ignore"):
            terms = _digests(batch.column("token")) * np.stack([_power(b, at) for b in _BASES], axis=1)
            sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(terms, axis=0, dtype=np.uint64)])
            totals = sums[1:] - sums[begin] + np.where(mine[:, None], total, np.uint64(0))
        length = np.concatenate([[0], np.cumsum(chars)])
        reach = length[1:] - length[begin] + upto * mine
        of, n, upto, total = ids[-1], int(at[-1]), int(reach[-1]), totals[-1]
        yield pa.RecordBatch.from_pydict(
            {"conv_id": batch.column("conv_id"), "part": pa.array(np.full(len(ids), part), pa.int32()), "at": pa.array(at), "chars": batch.column("chars"), "upto": pa.array(reach), "term": _binary(terms), "total": _binary(totals)}
        )


def _offsets(local: DataFrame) -> DataFrame:
    """(part, conv_id, turns, more, before) of conversations that go on from an earlier part: one row for each part at most."""
    last = F.max_by(F.struct("conv_id", "at", "upto", "total"), F.struct("conv_id", "at")).alias("last")
    out, now = [], None
    for row in local.groupBy("part").agg(F.min("conv_id").alias("first"), last).orderBy("part").collect():  # a row for each part
        goes_on = now is not None and now[0] == row.first
        if goes_on:
            out.append((row.part, row.first, now[1], now[2], now[3]))
        conv_id, n, upto, total = row.last
        if goes_on and conv_id == row.first:
            lanes = zip(np.frombuffer(now[3], "<u8").tolist(), np.frombuffer(bytes(total), "<u8").tolist(), _BASES, strict=True)
            total = np.array([(a + pow(b, now[1], 1 << 64) * t) & _ALL for a, t, b in lanes], "<u8").tobytes()
            n, upto = n + now[1], upto + now[2]
        now = (conv_id, n, upto, bytes(total))
    return local.sparkSession.createDataFrame(out, "part int, conv_id long, turns long, more long, before binary")


_TURNS = "conv_id long, at long, chars long, upto long, term binary, total binary"


def _moved_rows(batches):
    for batch in batches:
        n = batch.column("turns").to_numpy()
        with np.errstate(over="ignore"):
            times = np.stack([_power(b, n) for b in _BASES], axis=1)
            term, total = _digests(batch.column("term")) * times, _digests(batch.column("total")) * times + _digests(batch.column("before"))
        own = {"conv_id": batch.column("conv_id"), "at": pa.array(batch.column("at").to_numpy() + n), "chars": batch.column("chars")}
        yield pa.RecordBatch.from_pydict(own | {"upto": pa.array(batch.column("upto").to_numpy() + batch.column("more").to_numpy()), "term": _binary(term), "total": _binary(total)})


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, chars, upto, term, total): the turns of each conversation numbered from 1.

    ``total`` is the hash of the turns up to this one, ``term`` what this one
    adds to it, ``upto`` the code points so far.
    """
    spark = conversations.sparkSession
    common.bounded_batches(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), token.alias("token"), F.char_length(text).cast("long").alias("chars"))
    order = ("conv_id", "turn", "role", "token")
    placed = rows.repartitionByRange(common.tasks(spark), *order).sortWithinPartitions(*order)
    local = common.materialize(placed.select("conv_id", "token", "chars").mapInArrow(_local_rows, _LOCAL), "trie-parts")
    met = local.join(F.broadcast(_offsets(local)), ["part", "conv_id"], "left")  # a row for each part at most
    whole = met.withColumns({"turns": F.coalesce("turns", F.lit(0).cast("long")), "more": F.coalesce("more", F.lit(0).cast("long")), "before": F.coalesce("before", F.lit(NONE))})
    return whole.mapInArrow(_moved_rows, _TURNS)


# --- conversations that share their first turns --------------------------------------


def _rebuilt_rows(batches):
    """Hashes of the rebuilt prefixes: ``base`` and what the own turns after the ``cut`` add, moved by ``shift`` places."""
    for batch in batches:
        shift = batch.column("shift").to_numpy()
        with np.errstate(over="ignore"):
            times = np.stack([_power(b, shift) for b in _BASES], axis=1)
            hashes = _digests(batch.column("base")) + times * (_digests(batch.column("total")) - _digests(batch.column("cut")))
            above = hashes - times * _digests(batch.column("term"))
        own = {c: batch.column(c) for c in ("seq", "depth", "length", "before", "upto")}
        yield pa.RecordBatch.from_pydict(own | {"hash": _binary(hashes), "above": _binary(above)})


_PATHS = "seq long, depth long, length long, before long, upto long, hash binary, above binary"


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt_paths(turns: DataFrame, taken: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, ends) of conversations whose first turns are those of another one.

    Conversation c has the first ``taken`` turns (a column of ``conv_id``; none:
    0, under SHARED) of conversation c - c % 100, then its own after as many.
    ``paths``: (seq, depth, length, before, upto, hash, above), a row for each turn; ``ends``: (conv_id, length, hash).
    """
    taken = F.lit(0).cast("long") if taken is None else taken.cast("long")
    zero, none = F.lit(0).cast("long"), F.lit(NONE)
    first = common.materialize(turns.where(F.col("at") < SHARED), "trie-first-turns")
    at = lambda name: first.select(F.col("conv_id").alias(f"{name}_id"), F.col("at").alias(f"{name}_at"), F.col("upto").alias(f"{name}_upto"), F.col("total").alias(f"{name}_total"))
    sizes = common.materialize(turns.groupBy("conv_id").agg(F.max("at").alias("n")), "trie-sizes")
    other = sizes.select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    heads = sizes.withColumns({"h": taken, "source": F.col("conv_id") - F.col("conv_id") % 100}).join(other, "source", "left")
    heads = heads.withColumns({"own_h": F.least("h", "n"), "base_h": F.least("h", F.coalesce("source_n", zero))})
    heads = heads.join(at("own"), (F.col("conv_id") == F.col("own_id")) & (F.col("own_h") == F.col("own_at")), "left")
    heads = heads.join(at("base"), (F.col("source") == F.col("base_id")) & (F.col("base_h") == F.col("base_at")), "left")
    heads = heads.select(
        "conv_id", "source", "h", "base_h", (F.col("base_h") + F.col("n") - F.col("own_h")).alias("length"), F.coalesce("own_upto", zero).alias("own_upto"), F.coalesce("base_upto", zero).alias("base_upto"),
        F.coalesce("own_total", none).alias("cut"), F.coalesce("base_total", none).alias("base"),
    )
    heads = common.materialize(heads, "trie-heads")
    near = common.small(heads, 96)
    own = turns.join(near, "conv_id").where(F.col("at") > F.col("h"))
    moved = F.col("base_upto") - F.col("own_upto") + F.col("upto")
    own = own.select(
        F.col("conv_id").alias("seq"), (F.col("at") - F.col("h") + F.col("base_h")).alias("depth"), "length", (moved - F.col("chars")).alias("before"), moved.alias("upto"),
        (F.col("base_h") - F.col("h")).alias("shift"), "base", "cut", "term", "total",
    )
    lent = first.withColumnRenamed("conv_id", "source").join(near, "source").where(F.col("at") <= F.col("base_h"))
    lent = lent.select(
        F.col("conv_id").alias("seq"), F.col("at").alias("depth"), "length", (F.col("upto") - F.col("chars")).alias("before"), "upto",
        zero.alias("shift"), none.alias("base"), none.alias("cut"), "term", "total",
    )
    paths = common.materialize(own.unionByName(lent).mapInArrow(_rebuilt_rows, _PATHS), "trie-rows")
    ends = paths.where("depth = length").select(F.col("seq").alias("conv_id"), "length", "hash").unionByName(heads.where("length = 0").select("conv_id", "length", none.alias("hash")))
    return paths, ends


# --- the trie ------------------------------------------------------------------------

_TRIE = "seq long, lo long, hi long, first binary, handle binary, ext binary"


def _fattest(lo: str, hi: str) -> Column:
    """The depth of (lo, hi] that the greatest power of two divides; null for an empty interval."""
    return F.expr(f"case when {lo} < {hi} then {hi} & shiftleft(-1L, length(bin({lo} ^ {hi})) - 1) end")


def _with_keys(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Compacted nodes (seq, lo, hi) with the hashes of their first, two-fattest and last depths."""
    depths = nodes.withColumn("fat", _fattest("lo", "hi")).withColumn("depth", F.explode(F.array_distinct(F.array(F.col("lo") + 1, "fat", "hi"))))
    met = depths.join(paths.select("seq", "depth", "hash"), ["seq", "depth"])
    own = lambda depth: F.max(F.when(F.col("depth") == depth, F.col("hash")))
    return met.groupBy("seq", "lo", "hi").agg(own(F.col("lo") + 1).alias("first"), own(F.col("fat")).alias("handle"), own(F.col("hi")).alias("ext"))


def exit_edges(trie: DataFrame, batch: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """(seq, length, e_seq, e_lo, e_hi, met) of the paths ``batch`` (seq, length): the edge on which each leaves, and the depth up to which it is in the trie.

    The edge is null where a path leaves at a node into a turn that no child begins with.
    """
    hashes = paths.select("seq", "depth", "hash")
    node = trie.select(F.col("handle").alias("key"), F.col("seq").alias("t_seq"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), F.col("ext").alias("t_ext"))
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    now = batch.select("seq", "length", zero.alias("lo"), F.col("length").alias("hi"), nothing.alias("v_seq"), nothing.alias("v_lo"), zero.alias("v_hi"), F.lit(None).cast("binary").alias("v_ext"))
    hash_at = lambda depth, name: hashes.select("seq", F.col("depth").alias(depth), F.col("hash").alias(name))
    spread = F.unhex(F.md5(F.col("seq").cast("string").cast("binary")))  # a key that nothing has, instead of null: nulls would meet in one task
    for _ in range(deepest.bit_length()):  # the greatest power of two that divides the depth falls with each step
        now = now.withColumn("depth", _fattest("lo", "hi")).join(hash_at("depth", "key"), ["seq", "depth"], "left")
        now = now.withColumn("key", F.coalesce("key", spread)).join(node, "key", "left")
        hit = F.col("t_seq").isNotNull()
        now = now.select(
            "seq", "length", F.when(hit, F.col("t_hi")).otherwise(F.col("lo")).alias("lo"), F.when(~hit & F.col("depth").isNotNull(), F.col("depth") - 1).otherwise(F.col("hi")).alias("hi"),
            *(F.when(hit, F.col(f"t_{c}")).otherwise(F.col(f"v_{c}")).alias(f"v_{c}") for c in ("seq", "lo", "hi", "ext")),
        )
    now = now.join(hash_at("v_hi", "there"), ["seq", "v_hi"], "left")
    now = now.withColumn("whole", (F.col("v_hi") == 0) | F.coalesce(F.col("there") == F.col("v_ext"), F.lit(False))).withColumn("depth", F.when(F.col("whole"), F.col("v_hi") + 1))
    child = trie.select(F.col("first").alias("key"), F.col("seq").alias("c_seq"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    now = now.join(hash_at("depth", "key"), ["seq", "depth"], "left").withColumn("key", F.coalesce("key", spread)).join(child, "key", "left")
    edge = {f"e_{c}": F.when(F.col("whole"), F.col(f"c_{c}")).otherwise(F.col(f"v_{c}")) for c in ("seq", "lo", "hi")}
    left = common.materialize(now.select("seq", "length", "v_hi", *(v.alias(k) for k, v in edge.items())), "trie-exits")
    # how far a path follows its edge: prefixes are equal up to where they part
    asked = left.where("e_seq is not null").select("seq", "e_seq", "e_lo", "e_hi")
    mine = asked.join(hashes, "seq").where("depth > e_lo and depth <= e_hi").select("seq", "e_seq", "depth", "hash")
    same = mine.join(hashes.select(F.col("seq").alias("e_seq"), "depth", "hash"), ["e_seq", "depth", "hash"])
    met = same.groupBy("seq").agg(F.max("depth").alias("met"))
    out = left.join(met, "seq", "left").select("seq", "length", "e_seq", "e_lo", "e_hi", F.coalesce("met", "e_lo", "v_hi").alias("met"))
    return common.materialize(out, "trie-located")


def insert(trie: DataFrame, batch: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """``trie`` with the paths of ``batch`` (seq, length), whose rows are among ``paths``."""
    located = exit_edges(trie, batch, paths, deepest)
    edge = ["e_seq", "e_lo", "e_hi"]
    splits = located.where("e_seq is not null and met < e_hi").select(*edge, F.col("met").alias("at")).distinct()
    cut = splits.select(*edge).distinct()
    points = splits.unionByName(cut.withColumn("at", F.col("e_hi")))
    before = F.lag("at").over(Window.partitionBy(*edge).orderBy("at"))
    pieces = points.select(F.col("e_seq").alias("seq"), F.coalesce(before, "e_lo").alias("lo"), F.col("at").alias("hi"))
    # the turns beyond, compacted: a node where a path ends or where several go on
    beyond = paths.drop("length").join(located.select("seq", "length", "met"), "seq").where("depth > met")
    beyond = common.materialize(beyond.select("seq", "depth", "length", "met", "hash", "above"), "trie-beyond")
    nodes = beyond.groupBy("hash").agg(F.min("seq").alias("owner"), F.min("above").alias("above"), F.max(F.col("depth") == F.col("length")).alias("ends"))
    nodes = common.materialize(nodes, "trie-beyond-nodes")
    several = nodes.groupBy(F.col("above").alias("hash")).count().where("count > 1").select("hash", F.lit(True).alias("branches"))
    compact = nodes.join(several, "hash", "left").where("ends or branches").select("hash", "owner")
    lower = F.lag("depth").over(Window.partitionBy("seq").orderBy("depth"))
    created = beyond.join(compact, "hash").select("seq", "owner", F.coalesce(lower, "met").alias("lo"), F.col("depth").alias("hi")).where("seq = owner").drop("owner")
    kept = trie.join(cut.select(F.col("e_seq").alias("seq"), F.col("e_hi").alias("hi")), ["seq", "hi"], "left_anti")
    after = common.materialize(kept.select(trie.columns).unionByName(_with_keys(pieces.unionByName(created), paths).select(trie.columns)), "trie")
    for table in (located, beyond, nodes):
        common.discard(table)
    return after


def build(paths: DataFrame, distinct: DataFrame) -> DataFrame:
    """The compacted nodes of all the paths ``distinct`` (seq, length, hash), inserted in batches of the hash's shares."""
    spark = paths.sparkSession
    deepest = distinct.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    place = F.pmod(F.xxhash64("hash"), F.lit(64))
    trie = spark.createDataFrame([], _TRIE)
    for low, high in zip((0, *BATCHES), BATCHES, strict=False):
        old, trie = trie, insert(trie, distinct.where((place >= low) & (place < high) & (F.col("length") > 0)).select("seq", "length"), paths, deepest)
        common.discard(old)
    return trie


# --- expanded nodes --------------------------------------------------------------------


def _id_lists(batches):
    """(hash, part, n, ids): the decimal ids of each path in pieces of text; rows come in order of (hash, conv_id)."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        hashes, ids = batch.column("hash").to_pylist(), batch.column("conv_id").to_pylist()
        edge = [i for i in range(len(ids)) if i == 0 or hashes[i] != hashes[i - 1]] + [len(ids)]
        lists = [",".join(map(str, ids[a:b])) for a, b in zip(edge, edge[1:], strict=False)] if ids else []
        numbers = range(n, n + len(lists))
        n += len(lists)
        yield pa.RecordBatch.from_pydict({"hash": pa.array([hashes[a] for a in edge[:-1]] if ids else [], pa.binary()), "part": pa.array([part] * len(lists), pa.int32()), "n": pa.array(numbers, pa.int64()), "ids": pa.array(lists, pa.string())})


def _list_digests(batches):
    of, total = None, None
    for batch in batches:
        hashes, sums = [], []
        for key, ids in zip(batch.column("hash").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != of:
                if of is not None:
                    hashes.append(of)
                    sums.append(total.hexdigest())
                of, total = key, hashlib.sha256(ids.encode())
            else:
                total.update(f",{ids}".encode())
        yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes, pa.binary()), "ends_sha256": pa.array(sums, pa.string())})
    if of is not None:
        yield pa.RecordBatch.from_pydict({"hash": pa.array([of], pa.binary()), "ends_sha256": pa.array([total.hexdigest()], pa.string())})


def member_digests(ends: DataFrame) -> DataFrame:
    """(hash, ends_sha256) of the ascending, comma-joined ids of the conversations that end with each path.

    Ids are put into lists where they lie, so one task of the second step reads few rows however many conversations are equal.
    """
    tasks = common.tasks(ends.sparkSession)
    placed = ends.select("hash", "conv_id").repartitionByRange(tasks, "hash", "conv_id").sortWithinPartitions("hash", "conv_id")
    lists = placed.mapInArrow(_id_lists, "hash binary, part int, n long, ids string")
    return lists.repartition(tasks, "hash").sortWithinPartitions("hash", "part", "n").select("hash", "ids").mapInArrow(_list_digests, "hash binary, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, taken: Column | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns of the conversations (see ``rebuilt_paths`` for ``taken``).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): the least member, its length, the least member of the sequence
    without its last turn, the members, the sequences of one more turn, the
    childless ones below or equal, the code points that need not be read again
    where members share them (summed over all below or equal), and the digest of the members that end there.
    """
    turns = common.materialize(ordered_turns(conversations), "trie-turns")
    rows, ends = rebuilt_paths(turns, taken)
    ends = common.materialize(ends, "trie-ends")
    distinct = common.materialize(ends.groupBy("hash", "length").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("convs")), "trie-paths")
    paths = common.materialize(rows.join(common.small(distinct.select("seq")), "seq", "left_semi"), "trie-path-rows")
    common.discard(turns)
    trie = build(paths, distinct)
    zero, none = F.lit(0).cast("long"), F.lit(NONE)

    # the compacted nodes' parents, children and lengths of text
    at = lambda depth, *more: paths.select("seq", F.col("depth").alias(depth), *more)
    nodes = trie.join(at("lo", F.col("hash").alias("up"), F.col("upto").alias("from")), ["seq", "lo"], "left").join(at("hi", F.col("upto").alias("to")), ["seq", "hi"])
    nodes = common.materialize(nodes.select(F.col("ext").alias("node"), F.coalesce("up", none).alias("parent"), F.col("seq").alias("owner"), "lo", "hi", F.coalesce("from", zero).alias("from"), "to"), "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    # each path's compacted nodes, the root too
    above = paths.select("seq", F.col("hash").alias("node")).join(nodes.select("node", "owner", "hi"), "node")
    above = above.unionByName(distinct.select("seq", none.alias("node"), F.lit(None).cast("long").alias("owner"), zero.alias("hi")))
    above = common.materialize(above, "trie-above")
    ending = distinct.select("seq", "convs", F.col("hash").alias("node")).join(children, "node", "left").select("seq", "convs", F.col("n_children").isNull().cast("long").alias("leaf"))
    counts = above.join(ending, "seq").groupBy("node").agg(F.min("seq").alias("conv_id"), F.sum("convs").alias("n_convs"), F.sum("leaf").alias("n_leaves"))
    counts = common.materialize(counts, "trie-counts")
    saved = counts.join(nodes, "node").select("node", ((F.col("n_convs") - 1) * (F.col("to") - F.col("from"))).alias("saved"), F.col("owner").alias("seq"))
    lower = F.sum("saved").over(Window.partitionBy("seq").orderBy(F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1))
    below = above.join(saved, ["seq", "node"], "left").select("node", lower.alias("lower")).groupBy("node").agg(F.coalesce(F.sum("lower"), zero).alias("below"))
    facts = common.materialize(counts.join(below, "node").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-facts")

    # every depth of every edge
    edges = nodes.join(facts, "node").join(counts.select(F.col("node").alias("parent"), F.col("conv_id").alias("up_id")), "parent")
    spread = edges.withColumn("depth", F.explode(F.sequence(F.col("lo") + 1, F.col("hi")))).join(at("depth", "before").withColumnRenamed("seq", "owner"), ["owner", "depth"])
    last = F.col("depth") == F.col("hi")
    inner = spread.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("lo") + 1, F.col("up_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("to") - F.col("before"))).alias("saved_tokens"), F.when(last, F.col("node")).alias("hash"),
    )
    root = facts.where(F.col("node") == none).select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("below").alias("saved_tokens"), F.col("node").alias("hash"))
    out = inner.unionByName(root).join(member_digests(ends), "hash", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
