"""LM scoring by a gated recurrent model in numpy, trained and run in Spark tasks.

Tokens are the blank-separated words of a text (A-Z in lower case) and one end.
Every token belongs to an output class. Frequent words (``WORDS``) lie in
classes of ``CLASS_WORDS``; all others, unseen ones included, lie in classes of
their last letters. The model gives p(class | history) by a softmax over the
classes and, for frequent words, p(word | class, history) by one inside the
class; the others get their class's smoothed relative frequency. So every text
has a probability and no softmax is as wide as the vocabulary.

* Counting: all words of the training documents are counted by partial counts
  in the tasks and a shuffle. The whole vocabulary stays a distributed table;
  tasks get its most frequent words, at most ``DICTIONARY``, and words beyond are joined
  to the table, so that no count is missing and none is collected.
* Encoding: one scan turns every text into its symbols, with all that the words
  themselves decide; training and scoring read those.
* Training: every training document is read once, in ``ROUNDS`` parts. In a
  round each task starts from the round's model, trains by truncated
  backpropagation (windows of ``WINDOW`` tokens, state carried on between the
  windows of a document), and gives back its parameters, one row a task, which
  are averaged by the tokens that they saw, by a sum in two steps. The first
  round starts from a model fitted in the driver to a bounded sample: at most
  ``WARM_UP`` training documents of ``WARM_UP_TOKENS`` tokens at most (longer
  ones are not cut for it, and like all others train in the rounds).
* Scoring: documents run side by side in lanes; a lane carries its state from
  window to window through the whole document and is reset at its start.

Defined cases: null and empty texts are one end; long texts are scored whole;
repeated rows get a row each; a null id is held out; extra columns are ignored;
an empty table gives no rows. Without training documents only the smoothing
is left.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 512
CLASS_WORDS = 32
SUFFIX_CLASSES = 24
DICTIONARY = 65_536
HIDDEN = 16
WINDOW = 32
LANES = 512
BUFFER_TOKENS = 2_000_000
ROUNDS = 2
WARM_UP = 256
WARM_UP_TOKENS = 4096
#: Sums of parameters that reach the driver after a round.
PARTIAL_SUMS = 16
RATE = 0.01
SMOOTHING = 0.1
_ROWS = 2048
#: Distinct words that a counting task holds before it hands its counts on.
PARTIAL_COUNTS = 200_000
END = b"\n"


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


# --- vocabulary ----------------------------------------------------------------


class Vocabulary:
    """Classes of all words, counts of the dictionary's, and the totals that the smoothing takes."""

    def __init__(self, dictionary: list[tuple[bytes, int]], suffixes: list[bytes], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        frequent = [w for w, _ in dictionary[:WORDS]]
        self.n_words = len(frequent)
        self.top_classes = -(-self.n_words // CLASS_WORDS)
        self.suffixes = {s: self.top_classes + 1 + n for n, s in enumerate(suffixes)}
        self.rest = self.top_classes
        self.classes = self.top_classes + 1 + len(suffixes)
        # a token's number: frequent words first, then the classes of the others
        self.symbols = self.n_words + self.classes - self.top_classes
        self.index = {w: n for n, (w, _) in enumerate(dictionary)}
        self.symbol = np.array([n if n < self.n_words else self.symbol_of_class(self.suffix_class(w)) for n, (w, _) in enumerate(dictionary)], np.int32)
        self.log_count = np.log10(np.array([c for _, c in dictionary], float) + SMOOTHING)
        self.class_of_symbol = np.array([n // CLASS_WORDS for n in range(self.n_words)] + list(range(self.top_classes, self.classes)))
        self.log_base = math.log10(total + SMOOTHING * (distinct + 1))
        self.class_log = np.zeros(self.classes)
        self.word_counts = np.array([c for _, c in dictionary[:WORDS]], float)
        self.class_counts = np.zeros(self.classes)

    def symbol_of_class(self, c: int) -> int:
        return self.n_words + c - self.top_classes

    def suffix_class(self, word: bytes) -> int:
        """Class of a word that is not frequent: by its last three bytes, else its last two."""
        return self.suffixes.get(word[-3:]) or self.suffixes.get(word[-2:]) or self.rest

    def set_class_totals(self, totals: dict[int, tuple[int, int]]) -> None:
        """(count, distinct words) of each class of words that are not frequent."""
        self.class_counts[: self.top_classes] = np.bincount(self.class_of_symbol[: self.n_words], self.word_counts, minlength=self.classes)[: self.top_classes]
        for c in range(self.top_classes, self.classes):
            n, v = totals.get(c, (0, 0))
            self.class_counts[c] = n
            self.class_log[c] = math.log10(n + SMOOTHING * (v + 1))

    @property
    def start(self) -> int:
        """Symbol that stands before a document's first token: the end's."""
        return int(self.symbol[self.index[END]]) if END in self.index else 0

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words, their places in the dictionary (-1 for none), and where those without are."""
        place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        beyond = np.flatnonzero(place < 0)
        symbols = self.symbol[place] if len(self.symbol) else np.zeros(len(words), np.int32)
        if len(beyond):
            classes = self.suffix_class
            symbols[beyond] = [self.symbol_of_class(classes(words[i])) for i in beyond.tolist()]
        return symbols, place, beyond


# --- model -----------------------------------------------------------------------


class Model:
    """A gated recurrent layer over symbols with a class-factored output."""

    def __init__(self, symbols: int, classes: int, words: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        init = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        top = -(-words // CLASS_WORDS)
        self.p = {
            "input": init(symbols, 3 * h),  # embedding and input weights in one table
            "state": (np.tile(np.eye(h), (1, 3)) * 0.3 + rng.standard_normal((h, 3 * h)) * 0.1).astype(np.float32),
            "class_w": init(h, classes),
            "class_b": np.zeros(classes, np.float32),
            "word_w": init(top, h, CLASS_WORDS),
            "word_b": np.zeros((top, CLASS_WORDS), np.float32),
        }
        spare = top * CLASS_WORDS - words
        self.mask = np.zeros((top, CLASS_WORDS), np.float32)
        if spare:
            self.mask[-1, CLASS_WORDS - spare :] = -1e9

    def start_at(self, vocabulary: Vocabulary) -> None:
        """Biases at the corpus's shares, so that training starts from its word counts."""
        share = vocabulary.class_counts + SMOOTHING
        self.p["class_b"] = np.log(share / share.sum()).astype(np.float32)
        self.p["word_b"].ravel()[: vocabulary.n_words] = np.log(vocabulary.word_counts)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def set_flat(self, x: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = x[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def forward(self, inputs: np.ndarray, resets: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States (steps, lanes, hidden) after each input; ``h`` (lanes, hidden) comes in and is left as it was.

        Every step's arrays are contiguous (lanes, hidden) blocks, one for each gate.
        """
        table, u = self._by_gate("input"), self._by_gate("state")
        gates = np.empty((len(inputs), 2, *h.shape), np.float32)
        gates[:, 0], gates[:, 1] = table[0][inputs], table[1][inputs]
        fresh = table[2][inputs]
        states, before, pre = np.empty_like(fresh), np.empty_like(fresh), np.empty_like(fresh)
        for t in range(len(inputs)):
            if len(resets[t]):
                h = h.copy()
                h[resets[t]] = 0
            before[t] = h
            g, c, new = gates[t], fresh[t], states[t]
            g += np.matmul(h, u[:2])
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            pre[t] = h @ u[2]
            c += g[1] * pre[t]
            np.tanh(c, out=c)
            np.subtract(h, c, out=new)
            new *= g[0]
            new += c
            h = new
        return states, (inputs, resets, before, gates, pre, fresh)

    def _by_gate(self, name: str) -> np.ndarray:
        """A table of three gates side by side as (3, rows, hidden): update, reset, fresh state."""
        return np.ascontiguousarray(self.p[name].reshape(-1, 3, HIDDEN).swapaxes(0, 1))

    def outputs(self, states: np.ndarray, classes: np.ndarray, symbols: np.ndarray, words: int, gradients: bool) -> tuple:
        """Natural log probabilities of flat targets, and the gradients of their sum's negative."""
        score = np.empty(len(classes), np.float32)
        grads, back = {}, None
        if gradients:
            grads = {k: np.zeros_like(self.p[k]) for k in ("class_w", "class_b", "word_w", "word_b")}
            back = np.empty_like(states)
        ones = np.ones(max(self.p["class_b"].size, CLASS_WORDS), np.float32)
        for at in range(0, len(classes), _ROWS):  # blocks whose logits stay in the processor's cache
            s, target = states[at : at + _ROWS], classes[at : at + _ROWS]
            logits = s @ self.p["class_w"]
            logits += self.p["class_b"]
            _exponentials(logits)
            total = logits @ ones[: logits.shape[1]]
            rows = np.arange(len(target))
            score[at : at + _ROWS] = np.log(logits[rows, target] / total)
            if gradients:
                logits /= total[:, None]
                logits[rows, target] -= 1
                grads["class_w"] += s.T @ logits
                grads["class_b"] += logits.sum(axis=0)
                back[at : at + _ROWS] = logits @ self.p["class_w"].T
        frequent = np.flatnonzero(symbols < words)
        order = frequent[np.argsort(symbols[frequent] // CLASS_WORDS, kind="stable")]
        cuts = np.searchsorted(symbols[order] // CLASS_WORDS, np.arange(len(self.p["word_b"]) + 1))
        for c in range(len(cuts) - 1):
            own = order[cuts[c] : cuts[c + 1]]
            if not len(own):
                continue
            s = states[own]
            x = s @ self.p["word_w"][c] + (self.p["word_b"][c] + self.mask[c])
            _exponentials(x)
            n = x @ ones[: x.shape[1]]
            place = symbols[own] % CLASS_WORDS
            k = np.arange(len(own))
            score[own] += np.log(x[k, place] / n)
            if gradients:
                x /= n[:, None]
                x[k, place] -= 1
                grads["word_w"][c], grads["word_b"][c] = s.T @ x, x.sum(axis=0)
                back[own] += x @ self.p["word_w"][c].T
        return score, grads, back

    def backward(self, kept: tuple, back: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the recurrent part for the states' gradients ``back`` (steps, lanes, hidden)."""
        inputs, resets, before, gates, pre, fresh = kept
        z, r = gates[:, 0], gates[:, 1]
        # what the states' gradients are multiplied by, for all steps at once
        to_fresh = (1 - z) * (1 - fresh * fresh)
        to_gates = np.empty_like(gates)
        np.multiply((before - fresh) * z, 1 - z, out=to_gates[:, 0])
        np.multiply(pre * r, 1 - r, out=to_gates[:, 1])
        u = np.ascontiguousarray(self._by_gate("state").swapaxes(1, 2))
        d = np.empty((len(inputs), 3, *before[0].shape), np.float32)  # update, reset, and the fresh state's product
        d_fresh = np.empty_like(fresh)
        dh = np.zeros_like(before[0])
        for t in range(len(inputs) - 1, -1, -1):
            dh += back[t]
            own, dc = d[t], d_fresh[t]
            np.multiply(dh, to_fresh[t], out=dc)
            np.multiply(dh, to_gates[t, 0], out=own[0])
            np.multiply(dc, to_gates[t, 1], out=own[1])
            np.multiply(dc, r[t], out=own[2])
            through = np.matmul(own, u)
            dh *= z[t]
            dh += through[0]
            dh += through[1]
            dh += through[2]
            if len(resets[t]):
                dh[resets[t]] = 0
        order = np.argsort(inputs.ravel(), kind="stable")
        used, first = np.unique(inputs.ravel()[order], return_index=True)
        table, flat = np.zeros_like(self.p["input"]), before.reshape(-1, HIDDEN).T
        state = np.empty_like(self.p["state"])
        for k, x in enumerate((d[:, 0], d[:, 1], d_fresh)):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            table[used, part] = np.add.reduceat(x.reshape(-1, HIDDEN)[order], first, axis=0)
            state[:, part] = flat @ d[:, k].reshape(-1, HIDDEN)
        return {"input": table, "state": state}


def _exponentials(x: np.ndarray) -> None:
    """Exponentials of logits up to a factor for each row, in place: nothing overflows, and no row is all zeros."""
    top = x.max()
    if top - x.min() > 60:  # one factor for all rows might not do
        top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)


class _Adam:
    def __init__(self, model: Model, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, model: Model, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t) / (1 + self.t / 300) ** 0.5
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            model.p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _lanes(lengths: list[int]) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the shortest lane; lanes by falling length."""
    count = max(1, min(LANES, len(lengths)))
    order = np.argsort(-np.array(lengths), kind="stable").tolist()
    heap = [(0, n) for n in range(count)]
    lanes: list[list[int]] = [[] for _ in range(count)]
    for d in order:
        size, n = heapq.heappop(heap)
        lanes[n].append(d)
        heapq.heappush(heap, (size + lengths[d], n))
    return sorted(lanes, key=lambda lane: -sum(lengths[d] for d in lane))


def _windows(docs: list[np.ndarray], start: int) -> Iterator[tuple]:
    """(inputs, targets, resets, owner) of each window over the lanes: steps first, only lanes that are not over.

    The input of a document's first token is ``start``. Lanes end inside a
    window: their places beyond are -1 in ``targets``. The lanes lie one after
    another in one array and a window is read from it, so a long lane pads no other.
    """
    lanes = _lanes([len(d) for d in docs])
    order = [d for lane in lanes for d in lane]
    lengths = np.array([len(docs[d]) for d in order], np.int64)
    stream = np.concatenate([docs[d] for d in order]).astype(np.int32)
    owner = np.repeat(np.array(order, np.int32), lengths)
    begins = np.zeros(len(stream), bool)
    begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    sizes = np.array([sum(len(docs[d]) for d in lane) for lane in lanes], np.int64)
    base = np.cumsum(sizes) - sizes
    for at in range(0, int(sizes.max()), WINDOW):
        n = int((sizes > at).sum())
        step = at + np.arange(WINDOW)[:, None]
        real = step < sizes[None, :n]
        place = np.where(real, base[None, :n] + step, 0)
        first = real & begins[place]
        inputs = np.where(first | ~real, start, stream[place - 1]).astype(np.int32)
        yield inputs, np.where(real, stream[place], -1).astype(np.int32), [np.flatnonzero(x) for x in first], owner[place]


def train(model: Model, vocabulary: Vocabulary, docs: list[np.ndarray], adam: _Adam) -> None:
    """One pass of truncated backpropagation over documents of symbols."""
    start = vocabulary.start
    h = np.zeros((min(LANES, len(docs)), HIDDEN), np.float32)
    for inputs, target, resets, _ in _windows(docs, start):
        h = h[: inputs.shape[1]]
        states, kept = model.forward(inputs, resets, h)
        real = np.flatnonzero(target.ravel() >= 0)
        symbols = target.ravel()[real]
        flat = states.reshape(-1, HIDDEN)
        _, grads, back = model.outputs(flat[real], vocabulary.class_of_symbol[symbols], symbols, vocabulary.n_words, True)
        whole = np.zeros_like(flat)
        whole[real] = back
        grads |= model.backward(kept, whole.reshape(states.shape))
        adam.step(model, {k: g / len(real) for k, g in grads.items()})
        h = states[-1]


def score(model: Model, vocabulary: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each document's classes and frequent words."""
    out = np.zeros(len(docs))
    start = vocabulary.start
    h = np.zeros((min(LANES, len(docs)), HIDDEN), np.float32)
    for inputs, target, resets, owner in _windows(docs, start):
        h = h[: inputs.shape[1]]
        states, _ = model.forward(inputs, resets, h)
        real = np.flatnonzero(target.ravel() >= 0)
        symbols = target.ravel()[real]
        got, _, _ = model.outputs(states.reshape(-1, HIDDEN)[real], vocabulary.class_of_symbol[symbols], symbols, vocabulary.n_words, False)
        out += np.bincount(owner.ravel()[real], got.astype(np.float64), minlength=len(docs))
        h = states[-1]
    return out / math.log(10)


# --- Spark jobs --------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by ten."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))


def _count(batches):
    counts: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    for batch in common.batches(batches):
        for text in batch["text"]:
            counts.update(tokens(text))
        if len(counts) > PARTIAL_COUNTS:
            yield flush()
            counts = Counter()
    if counts:
        yield flush()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the training texts."""
    partial = training.select("text").mapInArrow(_count, "word binary, n long")
    return common.materialize(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _frequent(counts: DataFrame, most: int = DICTIONARY) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words (all, if there are fewer) with their counts, by falling count and then by word.

    Words are taken by levels of their counts, sixteen for each doubling, then by
    counts inside the level that no longer fits whole, then, of one count, by
    ranges of words: no task sends more than it has of what is taken.
    """
    level = F.floor(F.log2("n") * 16)

    def fitting(rows: DataFrame, key: Column, room: int):
        """Of the groups of ``key``, from the greatest on: the least that still fits whole, the next one, and the room that is left."""
        least = None
        for r in rows.groupBy(key.alias("key")).count().orderBy(F.desc("key")).collect():
            if r["count"] > room:
                return least, r["key"], room
            room -= r["count"]
            least = r["key"]
        return least, None, room

    taken, room = [], most
    least, split, room = fitting(counts, level, room)
    if least is not None:
        taken += counts.where(level >= least).collect()
    if split is not None and room:
        inside = counts.where(level == split)
        least, split, room = fitting(inside, F.col("n"), room)
        if least is not None:
            taken += inside.where(F.col("n") >= least).collect()
        if room:
            equal = counts.where(F.col("n") == split).repartitionByRange(common.tasks(counts.sparkSession), "word")
            equal = common.materialize(equal.withColumn("part", F.spark_partition_id()), "equal-counts")
            least, split, room = fitting(equal, -F.col("part"), room)
            if least is not None:
                taken += equal.where(F.col("part") <= -least).collect()
            taken += equal.where(F.col("part") == -split).orderBy("word").limit(room).collect() if room else []
            common.discard(equal)
    return sorted(((bytes(r["word"]), r["n"]) for r in taken), key=lambda x: (-x[1], x[0]))


def fit_vocabulary(counts: DataFrame) -> Vocabulary:
    """The dictionary, the suffix classes and all totals."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    dictionary = _frequent(counts)
    suffix = lambda k: F.expr(f"substring(word, greatest(1, length(word) - {k - 1}), {k})")
    suffixes: list[bytes] = []
    for k in (3, 2):
        rows = counts.where(F.length("word") >= k).groupBy(suffix(k).alias("s")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(SUFFIX_CLASSES).collect()
        suffixes += [bytes(r["s"]) for r in rows]
    vocabulary = Vocabulary(dictionary, suffixes, total or 0, distinct)
    frequent = frozenset(w for w, _ in dictionary[:WORDS])

    def classes(batches):
        for batch in batches:
            sums, kinds = Counter(), Counter()
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if w not in frequent:
                    c = vocabulary.suffix_class(w)
                    sums[c] += n
                    kinds[c] += 1
            yield pa.RecordBatch.from_pydict({"c": pa.array(sums.keys(), pa.int32()), "n": pa.array(sums.values(), pa.int64()), "v": pa.array([kinds[c] for c in sums], pa.int64())})

    per_class = counts.mapInArrow(classes, "c int, n long, v long").groupBy("c").agg(F.sum("n"), F.sum("v")).collect()
    vocabulary.set_class_totals({r[0]: (r[1], r[2]) for r in per_class})
    return vocabulary


def _encoded(rows: DataFrame, shipped) -> DataFrame:
    """All that scoring takes but the model: symbols, numbers of tokens, sums of logarithms, and the words beyond the dictionary."""

    def encode(batches):
        vocabulary = shipped.value
        for batch in common.batches(batches):
            known, base, lengths, rare, tails, symbols = [], [], [], [], [], []
            for t in batch["text"]:
                words = tokens(t)
                s, place, beyond = vocabulary.look_up(words)
                symbols.append(s.astype("<u2").tobytes())
                lengths.append(len(words))
                known.append(len(words) - len(beyond))
                logs = vocabulary.log_count[place] if len(beyond) < len(words) else np.zeros(len(words))
                logs[beyond] = 0
                base.append(logs.sum())
                own = s >= vocabulary.n_words
                rare.append(logs[own].sum() - vocabulary.class_log[vocabulary.class_of_symbol[s[own]]].sum())
                tails.append(Counter([words[i] for i in beyond.tolist()]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(batch["doc_id"], pa.int64()),
                    "held_out": pa.array(batch["held_out"], pa.bool_()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "n_known": pa.array(known, pa.int64()),
                    "base": pa.array(np.array(base) - np.array(lengths) * vocabulary.log_base),
                    "rare": pa.array(np.array(rare, float)),
                    "symbols": pa.array(symbols, pa.binary()),
                    "tail": _lists(tails),
                }
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, symbols binary, tail array<struct<word:binary,n:long>>"
    encoded = rows.mapInArrow(encode, schema)
    return common.materialize(encoded.select(F.monotonically_increasing_id().alias("row_id"), "*"), "encoded")


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2").astype(np.int32) for b in column.to_pylist()]


def _buffers(batches) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with the symbols of their documents, joined until they hold BUFFER_TOKENS."""
    held, docs, size = [], [], 0
    for batch in common.slices(batches):
        own = _symbols(batch.column("symbols"))
        held.append(batch)
        docs += own
        size += sum(map(len, own))
        if size >= BUFFER_TOKENS:
            yield held, docs
            held, docs, size = [], [], 0
    if held:
        yield held, docs


def _added(batches):
    """One row (x, n): the sums of the rows' vectors and numbers."""
    total, n = None, 0
    for batch in batches:
        for x, m in zip(batch.column("x").to_pylist(), batch.column("n").to_pylist(), strict=True):
            x = np.frombuffer(x, "<f8")
            total, n = x.copy() if total is None else total + x, n + m
    if total is not None:
        yield pa.RecordBatch.from_pydict({"x": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def fit(training: DataFrame, vocabulary: Vocabulary, shipped) -> Model:
    """Train over all training documents (row_id, n_tokens, symbols), in rounds of averaged local training."""
    spark: SparkSession = training.sparkSession
    model = Model(vocabulary.symbols, vocabulary.classes, vocabulary.n_words)
    model.start_at(vocabulary)
    if not vocabulary.total:
        return model
    sample = training.where(F.col("n_tokens") <= WARM_UP_TOKENS).select("symbols", F.xxhash64("symbols").alias("h")).orderBy("h").limit(WARM_UP)
    warm = [np.frombuffer(r["symbols"], "<u2").astype(np.int32) for r in sample.collect()]
    if warm:
        adam = _Adam(model, RATE)
        for _ in range(4):
            train(model, vocabulary, warm, adam)
    for round_ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model.flat())

        def local(batches, now=now):
            vocabulary = shipped.value
            own = Model(vocabulary.symbols, vocabulary.classes, vocabulary.n_words)
            own.set_flat(now.value)
            adam, seen = _Adam(own, RATE), 0
            for _, docs in _buffers(batches):
                seen += sum(map(len, docs))
                train(own, vocabulary, docs, adam)
            if seen:
                yield pa.RecordBatch.from_pydict({"x": pa.array([(own.flat().astype("<f8") * seen).tobytes()], pa.binary()), "n": pa.array([seen], pa.int64())})

        part = training.where(F.pmod(F.xxhash64("row_id"), F.lit(ROUNDS)) == round_)
        sums = part.select("symbols").mapInArrow(local, "x binary, n long").repartition(PARTIAL_SUMS).mapInArrow(_added, "x binary, n long").collect()
        if sums:
            model.set_flat(sum(np.frombuffer(r["x"], "<f8") for r in sums) / sum(r["n"] for r in sums))
    return model


def _lists(tails: list[Counter]) -> pa.Array:
    """Counters as lists of (word, n)."""
    word = pa.array(list(chain.from_iterable(tails)), pa.binary())
    n = pa.array(list(chain.from_iterable(t.values() for t in tails)), pa.int64())
    ends = np.concatenate([[0], np.cumsum([len(t) for t in tails])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([word, n], ["word", "n"]))


def log_likelihood(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    rows = common.texts_of(docs).withColumn("held_out", held_out(F.col("doc_id")))
    counts = word_counts(rows.where(~F.col("held_out")))
    vocabulary = fit_vocabulary(counts)
    shipped = spark.sparkContext.broadcast(vocabulary)
    encoded = _encoded(rows, shipped)
    fitted = spark.sparkContext.broadcast(fit(encoded.where(~F.col("held_out")).select("row_id", "n_tokens", "symbols"), vocabulary, shipped))

    def run(batches):
        for held, docs in _buffers(batches):
            scored = score(fitted.value, shipped.value, docs)
            kept = pa.Table.from_batches(held).drop_columns(["symbols"])
            yield from kept.append_column("score", pa.array(scored)).combine_chunks().to_batches()

    own = ("row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare")
    scored = encoded.select(*own, "symbols").mapInArrow(run, "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, score double")
    # words beyond the dictionary: their counts come from the whole table; unseen ones count 0
    tail = encoded.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.word", F.col("t.n").alias("times"))
    joined = tail.join(counts, "word", "left")
    log = F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTHING)
    beyond = joined.groupBy("row_id").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("seen"))
    out = scored.join(beyond, "row_id", "left")
    log, seen = F.coalesce("log", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + F.col("rare") + log).alias("score"))
