"""Best-fit packing of tokenised documents by a distributed grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; full pieces are
sequences of their own, the rest is packed. Pieces are dealt into demes by a
hash. A deme has ``ISLANDS`` islands, tasks of their own that each evolve a
population of packings (grouping representation: a packing is a list of bins).
The first island starts from best fit by falling length, all others from the
same with jittered lengths. Crossover injects whole well-filled bins of one
parent into the other and removes the bins that hold duplicates of the injected
pieces; mutation empties the worst bins and a few others. The displaced pieces
first take the places of smaller ones where they fill a bin better, and what is
then left over is best-fitted. An island stops at the least possible number of
bins, after ``STALL`` generations without a better packing, or after
``GENERATIONS``. After each epoch every island's best packing (its elite)
migrates to the next island of its deme, through a shuffle. Then each deme keeps
its best packing.

Bins that are filled less than ``WELL_FILLED`` are broken up and their pieces
dealt into new, fewer demes for another round, so that a deme's leftover is
packed with those of others, until one deme is left or ``MOST_ROUNDS`` are over;
the last round's bins all stay.

No text moves: tokenising leaves lengths and checksums, and those are packed. A
deme is bounded by ``DEME`` pieces, on average.

Defined cases: null and empty texts are the closing id alone, a piece of one
token; a text of any length is cut into pieces, of which only the last may be
short; repeated rows are packed each (their rows are alike); extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
CLOSING_ID = 0
DEME = 2_000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 80
STALL = 40
POPULATION = 4
WELL_FILLED = 0.97
MOST_ROUNDS = 4
#: Words whose ids a tokenising process remembers, in each of two generations: about 100 MB of a worker, which other stages go on with.
WORD_CACHE = 350_000
_PIECES = "piece_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


# --- tokenising --------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """What byte-level tokenizers read for a letter up to U+00FF: a character for each of its bytes, visible ones for themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letter = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {code: "".join(letter[b] for b in chr(code).encode()) for code in range(256)}


_BYTES = _byte_letters()


class _WordEncoder:
    """Ids of a text, word by word, for tokenizers that never join tokens across blanks.

    Blanks and line feeds separate words before any merging in such tokenizers
    (their pre-tokenizer drops white space), so ids of a text are those of its
    words in order. Ids of words are remembered; the words that are new in a
    batch are encoded together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {m: self._ids([m])[0] for m in ",."}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        find, out, holes, new = self.young.get, [], [], {}
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            ids = list(map(find, words))
            if None in ids:
                empty = [i for i, x in enumerate(ids) if x is None]
                own = [words[i] for i in empty]
                new.update(dict.fromkeys(own))
                holes.append((ids, empty, own))
            out.append(ids)
        if new:
            self._learn(new)
            for ids, empty, own in holes:
                for i, w in zip(empty, own, strict=True):
                    ids[i] = find(w)
        joined = [b"".join(ids) for ids in out]
        if len(self.young) > WORD_CACHE:
            self.old, self.young = self.young, {}
        return joined

    def _learn(self, words: dict[str, None]) -> None:
        """Put all ``words`` into the young generation."""
        young, old, marks = self.young, self.old, self.marks
        stems, unknown = {}, {}
        for w in words:
            if w in old:
                young[w] = old[w]
                continue
            # of plain words, case and a mark at the end don't touch the word's own ids
            stem, mark = (w[:-1], w[-1]) if w[-1:] in marks else (w, "")
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                stem = stem.lower()
                stems[w] = (stem, mark)
                if stem not in young and stem in old:
                    young[stem] = old[stem]
            else:
                unknown[w] = None
        model = self.tokenizer.model
        for stem in dict.fromkeys(x for x, _ in stems.values() if x not in young):
            # lower-case Latin letters are one pre-token that normalising leaves alone: straight to the merges of its bytes
            young[stem] = array("I", [t.id for t in model.tokenize(stem if stem.isascii() else stem.translate(_BYTES))]).tobytes()
        unknown = list(unknown)
        for at in range(0, len(unknown), 4096):
            part = unknown[at : at + 4096]
            young.update(zip(part, self._ids(part), strict=True))
        for w, (stem, mark) in stems.items():
            young[w] = young[stem] + marks[mark] if mark else young[stem]


@lru_cache(maxsize=1)
def _encoder(path: str) -> _WordEncoder:
    return _WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(piece_id, doc_id, piece, start, length, ids_crc32) of every document, tokenised with the closing id."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def cut(batches):
        encoder = _encoder(tokenizer)
        for batch in common.batches(batches, 1 << 20):
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder.encode(batch["text"]), strict=True):
                ids += closing
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(own) // 4, zlib.crc32(own)))
            doc, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            )

    cut_up = common.texts_of(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return common.materialize(cut_up.select(F.monotonically_increasing_id().alias("piece_id"), "*"), "pieces")


# --- grouping genetic algorithm ------------------------------------------------


class Packing:
    """Bins of piece numbers, and the room that each has left."""

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room
        self.known: tuple[int, float] | None = None

    @classmethod
    def of(cls, bins: list[list[int]], lengths: list[int], capacity: int) -> Packing:
        return cls(bins, [capacity - sum(lengths[i] for i in b) for b in bins])

    def copy_of(self, chosen: Iterable[int]) -> Packing:
        chosen = list(chosen)
        return Packing([list(self.bins[n]) for n in chosen], [self.room[n] for n in chosen])

    def cost(self, capacity: int) -> tuple[int, float]:
        """Bins, then minus the mean squared fill: fewer bins first, then fuller ones and an emptier rest. For a packing that is done."""
        if self.known is None:
            self.known = self._cost(capacity)
        return self.known

    def _cost(self, capacity: int) -> tuple[int, float]:
        return len(self.bins), -sum((1 - r / capacity) ** 2 for r in self.room) / max(1, len(self.bins))

    def best_fit(self, order: list[int], lengths: list[int], capacity: int) -> None:
        """Put the pieces, in the given order, where they leave the least room; new bins as needed."""
        free = sorted((r, n) for n, r in enumerate(self.room) if r)
        for i in order:
            at = bisect_left(free, (lengths[i], -1))
            if at < len(free):
                left, n = free.pop(at)
                self.bins[n].append(i)
            else:
                left, n = capacity, len(self.bins)
                self.bins.append([i])
                self.room.append(capacity)
            self.room[n] = left - lengths[i]
            if self.room[n]:
                insort(free, (self.room[n], n))

    def replace(self, displaced: list[int], lengths: list[int]) -> list[int]:
        """Give a displaced piece the place of one or two smaller ones of a bin where that fills it best; what is displaced then, the longest first."""
        pool = sorted((lengths[i], i) for i in displaced)
        for n in sorted((n for n, r in enumerate(self.room) if r), key=self.room.__getitem__):
            own, room = self.bins[n], self.room[n]
            sizes = [lengths[i] for i in own]
            groups = [(x, (k,)) for k, x in enumerate(sizes)]
            groups += [(x + sizes[j], (k, j)) for k, x in enumerate(sizes) for j in range(k + 1, len(sizes))]
            gain, best = 0, None
            for size, group in groups:
                at = bisect_left(pool, (size + room + 1,)) - 1  # the longest that would fit in
                if at >= 0 and pool[at][0] - size > gain:
                    gain, best = pool[at][0] - size, (group, at)
                    if gain == room:
                        break
            if best:
                group, at = best
                new = pool.pop(at)[1]
                for k in reversed(group):
                    i = own.pop(k)
                    insort(pool, (lengths[i], i))
                own.append(new)
                self.room[n] = room - gain
        return [i for _, i in reversed(pool)]


def _start(lengths: list[int], capacity: int, rng: np.random.Generator, first: bool) -> Packing:
    """Best fit by falling length, exactly or with jittered lengths."""
    size = np.array(lengths, float)
    order = np.argsort(-size if first else -size * rng.uniform(0.9, 1.1, len(size)), kind="stable").tolist()
    packing = Packing([], [])
    packing.best_fit(order, lengths, capacity)
    return packing


def _cross(a: Packing, b: Packing, capacity: int, rng: np.random.Generator) -> tuple[Packing, list[int]]:
    """``a`` with a random half of the well-filled bins of ``b`` injected whole, and the pieces that this displaces."""
    good = [n for n, r in enumerate(b.room) if r <= (1 - WELL_FILLED) * capacity]
    if not good:
        return a.copy_of(range(len(a.bins))), []
    child = b.copy_of(good[n] for n in rng.choice(len(good), max(1, len(good) // 2), replace=False))
    inside = {i for x in child.bins for i in x}
    kept = {n for n, x in enumerate(a.bins) if inside.isdisjoint(x)}
    rest = a.copy_of(sorted(kept))
    displaced = [i for n, x in enumerate(a.bins) if n not in kept for i in x if i not in inside]
    return Packing(child.bins + rest.bins, child.room + rest.room), displaced


def _mutate(packing: Packing, rng: np.random.Generator) -> tuple[Packing, list[int]]:
    """``packing`` without its emptiest bins and a few random ones, and their pieces."""
    count = len(packing.bins)
    share = max(2, count // 50)
    emptiest = sorted(range(count), key=lambda n: -packing.room[n])[:share]
    gone = {*emptiest, *rng.integers(0, count, share).tolist()}
    return packing.copy_of(n for n in range(count) if n not in gone), [i for n in sorted(gone) for i in packing.bins[n]]


def evolve(lengths: list[int], capacity: int, seed: int, packings: list[Packing], generations: int = GENERATIONS, first: bool = True) -> list[Packing]:
    """The population after some generations, best first. ``first``: whether it starts from best fit itself if no packing is given."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    key = lambda p: p.cost(capacity)
    people = [*packings]
    while len(people) < POPULATION and not (people and len(min(people, key=key).bins) <= least):
        people.append(_start(lengths, capacity, rng, first and not people))
    people.sort(key=key)
    best, since = key(people[0]), 0
    for _ in range(generations):
        if len(people[0].bins) <= least or since >= STALL:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child, displaced = _cross(people[a], people[b], capacity, rng)
        child, more = _mutate(child, rng) if child.bins else (child, [])
        child.best_fit(child.replace(displaced + more, lengths), lengths, capacity)
        people = sorted([*people, child], key=key)[:POPULATION]
        since = since + 1 if key(people[0]) >= best else 0
        best = min(best, key(people[0]))
    return people


def _as_bins(number: np.ndarray) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(number.tolist()):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def _island(capacity: int, seed: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """One epoch of an island: rows (deme, island, piece_id, length, own, guest) with the bins of its elite and of a migrant."""
    pdf = pdf.sort_values("piece_id", kind="stable").reset_index(drop=True)
    lengths, island = pdf["length"].tolist(), int(pdf["island"].iloc[0])
    packings = [Packing.of(_as_bins(pdf[c].to_numpy()), lengths, capacity) for c in ("own", "guest") if pdf[c].iloc[0] >= 0]
    best = evolve(lengths, capacity, seed + island, packings, first=island == 0)[0]
    own = np.empty(len(pdf), np.int64)
    for n, b in enumerate(best.bins):
        own[b] = n
    fill = capacity - np.array(best.room, np.int64)
    bins, square = best.cost(capacity)
    return pd.DataFrame({"deme": pdf["deme"], "island": pdf["island"], "piece_id": pdf["piece_id"], "length": pdf["length"], "own": own, "guest": np.int64(-1), "fill": fill[own], "bins": np.int64(bins), "square": float(square)})


def _epoch(capacity: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _island(capacity, seed, pdf)


_ISLAND = "deme long, island int, piece_id long, length long, own long, guest long, fill long, bins long, square double"


def _packed(rest: DataFrame, demes: int, capacity: int, round_: int) -> DataFrame:
    """(piece_id, length, deme, bin, fill) of one round: the best island's packing of each deme."""
    deme = F.pmod(F.xxhash64("piece_id", F.lit(round_)), F.lit(demes))
    state = rest.select(deme.alias("deme"), F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), "piece_id", "length", F.lit(-1).cast("long").alias("own"), F.lit(-1).cast("long").alias("guest"))
    for epoch in range(EPOCHS):
        seed = 1000 * round_ + 100 * epoch
        if epoch:
            migrants = state.select("deme", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "piece_id", "length", F.lit(-1).cast("long").alias("own"), F.col("own").alias("guest"))
            state = state.select("deme", "island", "piece_id", "length", "own", "guest").unionByName(migrants).groupBy("deme", "island", "piece_id", "length").agg(F.max("own").alias("own"), F.max("guest").alias("guest"))
        # islands are little data but much work: as many tasks as the session has partitions, not as few as their bytes suggest
        dealt = state.repartition(common.tasks(rest.sparkSession), "deme", "island")
        state = common.materialize(dealt.groupBy("deme", "island").applyInPandas(_epoch(capacity, seed), _ISLAND), "islands")
    best = state.groupBy("deme").agg(F.min(F.struct("bins", "square", "island")).alias("best")).select("deme", F.col("best.island").alias("island"))
    best = common.materialize(best, "elites")
    return state.join(common.small(best), ["deme", "island"]).select("piece_id", "length", "deme", F.col("own").alias("bin"), "fill")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (see ``pieces``) with sequence_id and offset: a gapless place for each piece."""
    whole = cut.where(F.col("length") == capacity).select(*cut.columns, F.lit(0).cast("long").alias("offset"), F.shiftleft("piece_id", 1).alias("sequence_id"))
    rest = cut.where(F.col("length") < capacity).select("piece_id", "length")
    done, round_ = [], 0
    n = rest.count()
    while n:
        demes = max(1, -(-n // DEME))
        packed = common.materialize(_packed(rest, demes, capacity, round_), "packed")
        round_ += 1
        last = demes == 1 or round_ == MOST_ROUNDS
        good = packed if last else packed.where(F.col("fill") >= WELL_FILLED * capacity)
        done.append(good.select("piece_id", F.concat_ws("-", F.lit(round_), "deme", "bin").alias("bin")))
        if last:
            break
        rest = packed.where(F.col("fill") < WELL_FILLED * capacity).select("piece_id", "length")
        n = rest.count()
    if not done:
        return whole
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    placed = cut.join(bins, "piece_id")
    # a bin is named by its least piece; odd numbers stay apart from the whole pieces' even ones
    own = Window.partitionBy("bin")
    before = own.orderBy("piece_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(*cut.columns, F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("offset"), (F.shiftleft(F.min("piece_id").over(own), 1) + 1).alias("sequence_id"))
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(pieces(docs, tokenizer, capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
