"""Weighted finite-state transducers over small alphabets, and their composition.

An arc reads a symbol and writes one, with a factor; a path multiplies the
factors that stand at the same place of all machines in a row. ``compose`` runs
one machine's output into the next. A composed machine is run over symbols that
carry weights: the weight of a path is the sum, over its places, of the place's
weight times the arc's factor, and the result is that of the best accepted path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

Arc = tuple[int, str, str, int, float]


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, read, written, next state, factor), start states by name, and the states that accept."""

    arcs: tuple[Arc, ...]
    starts: dict[str, int]
    accepting: frozenset[int]
    table: dict[tuple[int, str], tuple[tuple[int, str, float], ...]] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        table: dict[tuple[int, str], list] = {}
        for state, read, written, after, factor in self.arcs:
            table.setdefault((state, read), []).append((after, written, factor))
        object.__setattr__(self, "table", {k: tuple(v) for k, v in table.items()})

    def outputs(self, symbols: Iterable[str], start: str) -> Iterator[tuple[list[str], list[float]]]:
        """(symbols written, factors) of every accepted path; for tests and short inputs."""

        def go(state: int, rest: list[str]) -> Iterator[tuple[list[str], list[float]]]:
            if not rest:
                if state in self.accepting:
                    yield [], []
                return
            for after, written, factor in self.table.get((state, rest[0]), ()):
                for s, f in go(after, rest[1:]):
                    yield [written, *s], [factor, *f]

        return go(self.starts[start], list(symbols))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that writes what ``second`` writes on reading what ``first`` writes; factors multiply.

    Its start states are named by those of both, joined by a blank; only states
    that some start reaches and that reach an accepting one are kept.
    """
    numbers: dict[tuple[int, int], int] = {}
    number = lambda pair: numbers.setdefault(pair, len(numbers))
    starts = {f"{a} {b}".strip(): number((s, t)) for a, s in first.starts.items() for b, t in second.starts.items()}
    reads = sorted({a[1] for a in first.arcs})
    arcs: list[Arc] = []
    todo, seen = list(numbers), set(numbers)
    while todo:
        s, t = pair = todo.pop()
        for read in reads:
            for s2, between, f in first.table.get((s, read), ()):
                for t2, written, g in second.table.get((t, between), ()):
                    if (s2, t2) not in seen:
                        seen.add((s2, t2))
                        todo.append((s2, t2))
                    arcs.append((number(pair), read, written, number((s2, t2)), f * g))
    accepting = {n for (s, t), n in numbers.items() if s in first.accepting and t in second.accepting}
    useful = set(accepting)
    while more := {a[0] for a in arcs if a[3] in useful} - useful:
        useful |= more
    return Transducer(tuple(a for a in arcs if a[0] in useful and a[3] in useful), starts, frozenset(accepting))


class Matcher:
    """Best accepted paths of a transducer."""

    def __init__(self, machine: Transducer):
        self.starts, self.accepting = machine.starts, machine.accepting
        # of arcs between the same states on the same symbol only the best can lie on a best path
        best: dict[str, dict[int, dict[int, float]]] = {}
        for state, read, _, after, factor in machine.arcs:
            own = best.setdefault(read, {}).setdefault(state, {})
            own[after] = max(factor, own.get(after, factor))
        self.steps = {read: {s: tuple(to.items()) for s, to in by.items()} for read, by in best.items()}

    def weight(self, symbols: Iterable[tuple[str, float]], start: str) -> float | None:
        """Weight of the best accepted path over (symbol, weight of the place); None if none is accepted."""
        live = {self.starts[start]: 0.0}
        for read, weight in symbols:
            step, after = self.steps.get(read, {}), {}
            for state, total in live.items():
                for to, factor in step.get(state, ()):
                    x = total + weight * factor
                    if x > after.get(to, -1.0):
                        after[to] = x
            live = after
        return max((x for s, x in live.items() if s in self.accepting), default=None)
