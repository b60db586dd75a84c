"""Conversation structure repair: weighted interval parsing over spans of turns.

The role initials of a repaired conversation form ``(s?(ua)+)?``. A nonterminal
X(p, q) of the repair grammar derives the edits that lead from state p of that
pattern to state q; its rules are in Chomsky normal form, X(p, q) -> X(p, r)
X(r, q) and X(p, q) -> one edited turn, with insertions closed over: they may
stand before and after every turn. A span's cell holds, per nonterminal, the
least (cost, audit), and spans are combined bottom-up by their length. All
binary trees over a span derive the same edits, so each split gives the same
cell and one, in the middle, is enough: n - 1 combinations for n turns.

Turns are ordered by ranges of (conv_id, turn), so a long conversation is
parsed piece by piece in several tasks, whose cells are then combined in turn; a
piece of a conversation is at most one row for each range. Texts travel once, to
be written out in order with their edits.

Order: by turn (null first), then role, then the MD5 of the text. Defined cases:
null roles and texts are one space, so such texts are blank; an empty role has
no initial, hence no legal neighbour, and can only be deleted or given another
role; rows without a conv_id are one conversation; a conversation without rows
has no result; repeated rows are duplicates; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Costs of the edits, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: State after an initial: nothing yet, after s, after u, after a.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
STATES, FINAL = 4, (0, 3)
#: The only initial that an inserted turn or a new role can have in a state.
FRESH = {0: "u", 1: "u", 2: "a", 3: "u"}
_BLANKS = " \t\n\x0b\x0c\r"
#: Turns of a span whose cells are remembered between conversations.
_REMEMBERED = 16

Cells = dict[tuple[int, int], tuple[int, str]]


# --- the parse ---------------------------------------------------------------


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of two adjacent spans' span."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(STATES):
            if (r, q) in right:
                more, rest = right[r, q]
                best = out.get((p, q))
                if best is None or cost + more < best[0] or (cost + more == best[0] and audit + rest < best[1]):
                    out[p, q] = (cost + more, audit + rest)
    return out


@lru_cache(1)
def insertions() -> Cells:
    """Cells of the empty span: insertions until none makes a cell better."""
    one = {(p, p): (0, "") for p in range(STATES)} | {(p, STEPS[FRESH[p], p]): (INSERT, "I") for p in range(STATES)}
    now: Cells = {(p, p): (0, "") for p in range(STATES)}
    while (after := combine(now, one)) != now:
        now = after
    return now


@lru_cache(None)
def turn_cells(kind: str) -> Cells:
    """Cells of one turn: u, a, s or o (any other initial), as a capital if truncated; x must go."""
    edits: Cells = {(p, p): (DELETE, "D") for p in range(STATES)}
    extra = TRUNCATED if kind.isupper() else 0
    if kind != "x":
        for p in range(STATES):
            for cost, letter, initial in ((REROLE, "R", FRESH[p]), (KEEP, "K", kind.lower())):
                if (initial, p) in STEPS:
                    own = (cost + extra, letter)
                    at = (p, STEPS[initial, p])
                    edits[at] = min(edits.get(at, own), own)
    return combine(combine(insertions(), edits), insertions())


@lru_cache(1 << 15)
def _short(kinds: str) -> Cells:
    if len(kinds) == 1:
        return turn_cells(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combine(_short(kinds[:half]), _short(kinds[half:]))


def span_cells(kinds: str) -> Cells:
    """Cells of the span of all turns, from spans of one turn up, twice as long each time."""
    if not kinds:
        return insertions()
    spans = [_short(kinds[at : at + _REMEMBERED]) for at in range(0, len(kinds), _REMEMBERED)]
    while len(spans) > 1:
        spans = [combine(*spans[n : n + 2]) if n + 1 < len(spans) else spans[n] for n in range(0, len(spans), 2)]
    return spans[0]


def cheapest(cells: Cells) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cells[0, q] for q in FINAL if (0, q) in cells)


# --- faults and audits ---------------------------------------------------------


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, cut, n): the distinct rows, how often each stands there, and what its text lacks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    seen = F.rtrim(text, F.lit(_BLANKS))
    columns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"),
        (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    return columns.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))


def _place() -> Column:
    """A turn as something to order by, nulls first."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def _kinds(distinct: DataFrame) -> DataFrame:
    """The distinct rows with their counts of each first fault and the kinds of all they stand for (see ``turn_cells``)."""
    same = lambda c: F.col(c).eqNullSafe(F.col(f"first_{c}"))
    first = distinct.groupBy(F.col("conv_id").alias("first_conv_id"), F.col("role").alias("first_role"), F.col("digest").alias("first_digest")).agg(F.min(_place()).alias("first"))
    met = distinct.join(first, same("conv_id") & same("role") & same("digest"))
    fresh = ~F.col("blank") & (_place() == F.col("first"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    letter = F.when(F.col("cut"), F.upper(letter)).otherwise(letter)
    gone = F.when(fresh, F.col("n") - 1).otherwise(F.col("n"))
    none = F.lit(0).cast("long")
    return met.select(
        "conv_id", "turn", "role", "digest", "n", initial.alias("initial"),
        F.when(F.col("blank"), F.col("n")).otherwise(none).alias("blank"), F.when(F.col("blank"), none).otherwise(gone).alias("duplicate"), (fresh & F.col("cut")).cast("long").alias("truncated"),
        F.concat(F.when(fresh, letter).otherwise(""), F.repeat(F.lit("x"), gone.cast("int"))).alias("kinds"),
    )


_PIECE = "conv_id long, part int, low long, high long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, cells array<struct<p:int,q:int,cost:long,audit:string>>"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Piece:
    """What one task has seen of one conversation, in order."""

    def __init__(self):
        self.low = self.high = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.kinds: list[str] = []

    def add(self, turn, n, initial, blank, duplicate, truncated, kinds) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += (n - 1) * (not _legal(initial, initial)) + (self.last is not None and not _legal(self.last, initial))
        self.first, self.last = initial if self.first is None else self.first, initial
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.kinds.append(kinds)

    def row(self, conv_id, part: int) -> dict:
        cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in span_cells("".join(self.kinds)).items()]
        own = {k: v for k, v in vars(self).items() if k != "kinds"}
        return {"conv_id": conv_id, "part": part, "cells": cells} | own


def _pieces(schema: pa.Schema):
    def run(batches):
        part, of, piece = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "n", "initial", "blank", "duplicate", "truncated", "kinds"))
            for conv_id, *rest in zip(*columns, strict=True):
                if piece is None or conv_id != of:
                    if piece is not None:
                        out.append(piece.row(of, part))
                    of, piece = conv_id, _Piece()
                piece.add(*rest)
            yield pa.RecordBatch.from_pylist(out, schema)
        if piece is not None:
            yield pa.RecordBatch.from_pylist([piece.row(of, part)], schema)
        common.release()

    return run


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _finished(row: dict) -> dict:
    """A conversation's result from its pieces, in order."""
    cells, last, high = insertions(), None, None
    out = {k: 0 for k in ("blank", "duplicate", "truncated", "illegal")}
    turns, low = 0, None
    for piece in row["pieces"]:
        for k in out:
            out[k] += piece[k]
        out["illegal"] += last is not None and not _legal(last, piece["first"])
        last = piece["last"]
        if piece["high"] is not None:
            turns += piece["turns"] - (piece["low"] == high)
            low, high = piece["low"] if low is None else low, piece["high"]
        cells = combine(cells, {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in piece["cells"]})
    cost, audit = cheapest(cells)
    return out | {"conv_id": row["conv_id"], "gaps": 0 if low is None else high - low + 1 - turns, "cost": cost, "audit": audit}


def _finish(schema: pa.Schema):
    def run(batches):
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_pylist([_finished(row) for row in batch.to_pylist()], schema)

    return run


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def structure(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of ``conversations`` (conv_id, turn, role, text): faults, and the cheapest edits.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit); the audit
    has an initial for each edit: Keep, Rerole, Delete, Insert.
    """
    spark = conversations.sparkSession
    common.bounded_batches(spark)
    distinct = common.materialize(_faults(conversations), "repair-rows")
    kinds = common.materialize(_kinds(distinct), "repair-kinds")
    common.discard(distinct)
    order = ("conv_id", "turn", "role", "digest")
    placed = kinds.repartitionByRange(common.tasks(spark), *order).sortWithinPartitions(*order)
    pieces = placed.mapInArrow(_pieces(_arrow(_PIECE)), _PIECE)
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in pieces.columns if c != "conv_id")))).alias("pieces"))  # the part comes first
    return whole.mapInArrow(_finish(_arrow(_RESULT)), _RESULT)


# --- repaired turns ---------------------------------------------------------------

_REPAIRED = "conv_id long, position long, edit string, role string, text string"


def _apply_edits(schema: pa.Schema):
    def run(batches):
        edits, at, state, position, of = "", 0, 0, 0, None

        def fresh(text: str, letter: str) -> dict:
            nonlocal state, position
            initial = FRESH[state]
            state, position = STEPS[initial, state], position + 1
            return {"conv_id": of, "position": position - 1, "edit": letter, "role": ROLES[initial], "text": text}

        def inserted():
            nonlocal at
            while edits[at : at + 1] == "I":
                at += 1
                yield fresh("", "I")

        for batch in common.slices(batches):
            out = []
            for conv_id, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if audit is not None:  # a conversation begins with its audit
                    edits, at, state, position, of = audit, 0, 0, 0, conv_id
                else:
                    letter, at = edits[at], at + 1
                    if letter == "R":
                        out.append(fresh(text, "R"))
                    elif letter == "K":
                        state = STEPS[role[0], state]
                        out.append({"conv_id": of, "position": position, "edit": "K", "role": role, "text": text})
                        position += 1
                out += inserted()
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repaired(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns that are left and inserted: (conv_id, position, edit, role, text), by ``audits`` (conv_id, audit) of ``structure``.

    A conversation's turns come in order from one task, which streams them.
    """
    spark = conversations.sparkSession
    common.bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    none = F.lit(None).cast("string")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"), F.md5(text.cast("binary")).alias("digest"), none.alias("audit"), F.lit(1).alias("kind"),
    )
    heads = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("digest"), "audit", F.lit(0).alias("kind"))
    dealt = rows.unionByName(heads).repartition(common.tasks(spark), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return dealt.mapInArrow(_apply_edits(_arrow(_REPAIRED)), _REPAIRED)


def _hash_turns(batches):
    of, total, ids, sums = None, None, [], []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            if total is None or conv_id != of:
                if total is not None:
                    ids.append(of)
                    sums.append(total.hexdigest())
                of, total = conv_id, hashlib.sha256(line)
            else:
                total.update(b"\n" + line)
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": pa.array(sums, pa.string())})
        ids, sums = [], []
    if total is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([of], pa.int64()), "repaired_sha256": pa.array([total.hexdigest()], pa.string())})


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over the ``role:text`` lines of what ``repaired`` returns, in the order of its tasks."""
    return turns.mapInArrow(_hash_turns, "conv_id long, repaired_sha256 string")


# --- faults put in ----------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults in about a quarter of the rows, picked by the CRC-32 of conv_id and turn."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), pick.alias("pick")).where("pick != 0")
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("pick") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def repair_report(all_ids: DataFrame, conversations: DataFrame) -> DataFrame:
    """``structure`` and the digest of the repaired turns for every conv_id of ``all_ids``, also those without a row in ``conversations``."""
    found = common.materialize(structure(conversations), "repair-audits")
    digests = turn_digests(repaired(conversations, found.select("conv_id", "audit")))
    renamed = lambda df, name: df.withColumnRenamed("conv_id", name)
    ids = all_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = ids.join(renamed(found, "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    met = met.join(renamed(digests, "its"), F.col("conv_id").eqNullSafe(F.col("its")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    value = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    empty = hashlib.sha256(b"").hexdigest()
    return met.select("conv_id", *value, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
