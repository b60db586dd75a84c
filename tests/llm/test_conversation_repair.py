"""Conversation repair against an exhaustive search and a plain left-to-right search."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from conftest import SF

from assetlake.llm import conversation_repair as repair
from assetlake.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, part int, kinds string"
BLANKS = " \t\n\v\f\r"


def plain_faults(rows):
    """(blank, duplicate, truncated, kinds) of rows in order, each (turn, role, text)."""
    seen, counts, kinds = set(), [0, 0, 0], []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        if not bare:
            fault = 0
        elif (role, text) in seen:
            fault = 1
        else:
            fault = 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        kinds.append((role[:1], fault))
    return counts, kinds


def choices(initial, fault):
    """(cost, letter, new initial or none) of a row's edits."""
    yield 2, "D", ""
    if fault not in (0, 1):
        more = 5 * (fault == 2)
        yield more, "K", initial or "-"
        for to in "ua":
            yield 1 + more, "R", to


def exhaustive(kinds, most=3):
    slots = [[(5 * n, "I" * n, "".join(x)) for n in range(most + 1) for x in product("ua", repeat=n)]] * (len(kinds) + 1)
    best = None
    for gaps in product(*slots):
        for own in product(*(list(choices(*k)) for k in kinds)):
            parts = [gaps[0]] + [x for pair in zip(own, gaps[1:], strict=True) for x in pair]
            if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in parts)):
                found = (sum(p[0] for p in parts), "".join(p[1] for p in parts))
                best = found if best is None else min(best, found)
    return best


NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def left_to_right(kinds):
    """(cost, audit, state path) by the best way to each state after each row."""

    def insert(now):
        for _ in range(6):
            for state, (cost, audit) in list(now.items()):
                for to, after in NEXT[state].items():
                    if to in "ua":
                        new = (cost + 5, audit + "I")
                        now[after] = min(now.get(after, new), new)
        return now

    now = insert({0: (0, "")})
    for kind in kinds:
        after = {}
        for state, (cost, audit) in now.items():
            for more, letter, to in choices(*kind):
                end = state if letter == "D" else NEXT[state].get(to)
                if end is not None:
                    new = (cost + more, audit + letter)
                    after[end] = min(after.get(end, new), new)
        now = insert(after)
    return min(now[s] for s in (0, 3) if s in now)


def plain_repaired(rows, audit):
    out, rows = [], iter(rows)
    for letter in audit:
        row = next(rows) if letter != "I" else None
        wanted = "assistant" if out and out[-1].startswith("u") else "user"
        if letter == "K":
            out.append(f"{row[1]}:{row[2]}")
        elif letter != "D":
            out.append(f"{wanted}:{row[2] if row else ''}")
    assert next(rows, None) is None
    return "\n".join(out)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        role, text, pick = s(role), s(text), zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        out += [(conv, turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)
    return out


def plain_report(rows):
    groups = {r[0]: [] for r in rows}
    for conv, *rest in plain_damage(rows):
        groups[conv].append(tuple(rest))
    out = set()
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        counts, kinds = plain_faults(own)
        cost, audit = left_to_right(kinds)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        out.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(plain_repaired(own, audit).encode()).hexdigest()))
    return out


def test_cells_against_exhaustive_search():
    rng = random.Random(4)
    code = {0: "x", 1: "x"}
    for n in range(120):
        kinds = [(rng.choice("uuaasx"), rng.choice((None, None, 2, 0))) for _ in range(n % 4)]
        coded = "".join(code.get(f) or (i.replace("x", "o").upper() if f == 2 else i.replace("x", "o")) for i, f in kinds)
        wanted = exhaustive(kinds, 2 if n % 4 == 3 else 3)
        assert repair.cheapest(repair.span_cells(coded)) == wanted == left_to_right(kinds)


def test_every_split_gives_the_same_cell():
    rng = random.Random(5)
    for n in range(2, 40):
        kinds = "".join(rng.choice("uasoUASOx") for _ in range(n))
        whole = repair.span_cells(kinds)
        assert all(repair.combine(repair.span_cells(kinds[:k]), repair.span_cells(kinds[k:])) == whole for k in range(n + 1))


ODD = [
    (1, None, None, None), (1, None, "user", "Hello."), (1, 3, "", "No role."), (1, 9, "assistant", "x" * 200_000), (1, 3, "tool", "Odd!"), (None, 1, "user", "Nobody's?"), (None, 2, "assistant", "Yes."), (2, 1, "system", "S. "),
    (2, 1, "system", "S. "), (2, 2, "umpire", "Kept as it is."), (2, 2, "umpire", "Kept as it is."), (2, 3, "user", "É, cut"), (3, 0, "user", "   "), (4, 5, "assistant", "One?\n"),
]


def report(spark, rows):
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], SCHEMA)
    got = repair.repair_report(df, repair.damaged(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {tuple(r) for r in got.collect()}


def test_report_against_plain_loops(spark):
    rng = random.Random(6)
    rows = list(ODD)
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn * rng.choice((1, 1, 2)), rng.choice(("user", "assistant", "assistant", "system", "other", None)), rng.choice(("Fine.", "cut off", "", "What?", f"text {rng.random()}."))))
    assert report(spark, rows) == plain_report(rows)


def test_long_conversation_in_pieces(spark):
    """One conversation far longer than the others: several tasks hold pieces of it."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(("user", "assistant", "system")), rng.choice((f"t{t}.", f"t{t}", "Again."))) for t in range(4000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    assert report(spark, rows) == plain_report(rows)


def test_nothing(spark):
    assert report(spark, []) == set()


def test_query_against_plain_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, SF).collect()
    assert {tuple(r) for r in got} == plain_report(rows) and len(got) == len({r[0] for r in rows})
    by = defaultdict(int)
    for r in got:
        by["edited"] += r.cost > 0
    assert by["edited"]


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "Q?"), (1, 2, "assistant", "Cut")], "conv_id long, turn long, role string, text string")
    found = repair.structure(df)
    assert [(r.cost, r.audit) for r in found.collect()] == [left_to_right([("a", None), ("u", None), ("a", 2)])]
    turns = repair.repaired(df, found).orderBy("position").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns)) and [r.position for r in turns] == list(range(len(turns)))
