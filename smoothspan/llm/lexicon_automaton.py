"""Toxicity by Levenshtein automata intersected with a lexicon trie, with context windows.

The lexicon (words and word stems whose presence goes with label 1) is learned from a bounded sample of labelled documents.
One automaton recognises all words within the edit bound of any term: its states are sets of (trie node, edits), built when
first met and kept. Every distinct word of a block walks it once, whatever its length, and so does each piece between punctuation
inside a word. A hit counts as abuse unless the window around it shows a
quotation (open quotation marks, or a line that starts with ``>``); abuse, misspelled abuse and quotation are separate
features of a logistic model fitted on the same sample.

Defined results: null and empty texts have no hits and get the model's base score; very long texts and words are read whole;
of the terms that a word may be a misspelling of the one with the fewest edits counts; an empty table gives no rows; repeated rows get repeated scores; labels
given twice for an id count as toxic if one of them is; null ids and null labels are not learned from; without both labels in
the sample, the score is the share of label 1 (0 without labels). Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothspan.llm.bytescan import blocks, text_buffers, words
from smoothspan.llm.workers import returning_memory


@dataclass(frozen=True)
class ToxicSettings:
    """``sample_rows``: most labelled documents that are learned from, the first by a hash of the id. ``min_support``: toxic
    documents that must hold a word (``stem_support`` a stem). ``purity``: least share of label 1 among documents with it.
    ``max_terms``: size bound of the lexicon, best first. ``window``: bytes of context on each side of a hit."""

    sample_rows: int = 6000
    min_support: int = 4
    stem_support: int = 8
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    purity: float = 0.8
    max_terms: int = 3000
    window: int = 160
    known_words: int = 200_000


@dataclass(frozen=True)
class ToxicModel:
    terms: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    weights: tuple[float, ...] = field(default=(0.0,))
    settings: ToxicSettings = ToxicSettings()


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Deterministic states are met lazily, and dropped between words beyond ``most_states``. ``match`` gives the fewest edits to
    a term, or None."""

    def __init__(self, terms: tuple[str, ...], stems: tuple[str, ...] = (), most_states: int = 40_000):
        self.most_states = most_states
        self.child: list[dict[str, int]] = [{}]
        self.allowed = [0]
        self.ends: list[int | None] = [None]
        self.stem_ends: list[int | None] = [None]
        for group, stem in ((terms, False), (stems, True)):
            for term in group:
                most, node = 0 if stem else edits_allowed(term), 0
                for c in term:
                    self.allowed[node] = max(self.allowed[node], most)
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.allowed.append(0)
                        self.ends.append(None)
                        self.stem_ends.append(None)
                    node = self.child[node][c]
                self.allowed[node] = max(self.allowed[node], most)
                (self.stem_ends if stem else self.ends)[node] = most
        self._forget()

    def _forget(self) -> None:
        """Drop the states met so far; they are met again when needed."""
        self.states: list[bytes] = []  # 4 * node + edits of each node, as 32-bit numbers
        self.number: dict[tuple[bytes, int | None], int] = {}
        self.accept: list[int | None] = []
        self.absorbed: list[bool] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], held: int | None) -> int:
        todo = list(nodes)
        while todo:  # letters of the term that the word lacks
            node = todo.pop()
            e = nodes[node] + 1
            for to in self.child[node].values() if e <= self.allowed[node] else ():
                if e <= self.allowed[to] and e < nodes.get(to, 99):
                    nodes[to] = e
                    todo.append(to)
        for node, e in nodes.items():
            if self.stem_ends[node] is not None and e <= self.stem_ends[node]:
                held = e if held is None else min(held, e)
        packed = array("i", sorted(4 * node + e for node, e in nodes.items())).tobytes()
        key = (packed, held)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(packed)
            best = [e for node, e in nodes.items() if self.ends[node] is not None and e <= self.ends[node]]
            self.accept.append(min([*best, *([held] if held is not None else [])], default=None))
            self.absorbed.append(held == 0)
            self.moves.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for x in array("i", self.states[state]):
            node, e = divmod(x, 4)
            to = self.child[node].get(c)
            if to is not None and e <= self.allowed[to]:
                nodes[to] = min(nodes.get(to, 99), e)
            if e + 1 <= self.allowed[node]:  # a letter too many, or another letter
                nodes[node] = min(nodes.get(node, 99), e + 1)
                for to in self.child[node].values():
                    if e + 1 <= self.allowed[to]:
                        nodes[to] = min(nodes.get(to, 99), e + 1)
        held = 0 if self.absorbed[state] else None
        to = self._state(nodes, held) if nodes or held is not None else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> int | None:
        if len(self.states) > self.most_states:
            self._forget()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
            if self.absorbed[state]:
                return 0
        return self.accept[state]


_LEAD = re.compile(r"[^\w\s]*")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """Lower case, without punctuation around it."""
    return _EDGE.sub("", word.lower())


_BETWEEN = re.compile(r"[\W_]+")


def readings(word: str) -> set[str]:
    """What a run without white space may stand for: the run itself and the pieces between its punctuation."""
    whole = bare(word)
    return ({whole, *_BETWEEN.split(whole)} if _BETWEEN.search(whole) else {whole}) - {""}


_OPEN, _CLOSE = "«“„", "»”"


def is_quoted(before: str, after: str) -> bool:
    """Whether the window around a hit shows a quotation; only its line counts."""
    line = before.rsplit("\n", 1)[-1]
    rest = after.split("\n", 1)[0]
    if line.lstrip().startswith(">"):
        return True
    if line.count('"') % 2 and '"' in rest:
        return True
    opened = max(line.rfind(c) for c in _OPEN)
    closed = max(line.rfind(c) for c in _CLOSE)
    return opened > closed and any(c in rest for c in _CLOSE)


FEATURES = ("base", "abuse", "abuse_any", "misspelled", "misspelled_any", "quoted", "density", "length")


class ToxicScorer:
    def __init__(self, model: ToxicModel):
        self.model = model
        self.automaton = LexiconAutomaton(model.terms, model.stems)
        self.known: dict[int, int] = {}

    def _edits(self, word: str) -> int:
        found = [e for e in map(self.automaton.match, readings(word)) if e is not None]
        return min(found, default=-1)

    def features(self, column: pa.Array) -> np.ndarray:
        raw, offsets = text_buffers(column)
        out = np.zeros((len(offsets) - 1, len(FEATURES)))
        out[:, 0] = 1.0
        for first, rows, part, at in blocks(raw, offsets):
            value, start, row = words(part, at)
            if not len(value):
                continue
            distinct, where, back = np.unique(value, return_index=True, return_inverse=True)
            if len(self.known) > self.model.settings.known_words:
                self.known.clear()
            known, edits = self.known, np.empty(len(distinct), np.int8)
            ends = np.append(start[1:], len(part))
            data = part.tobytes()
            for k, (h, w) in enumerate(zip(distinct.tolist(), where.tolist(), strict=True)):
                e = known.get(h)
                if e is None:
                    s = int(start[w])
                    stop = min(int(ends[w]), int(at[row[w] + 1]))
                    e = known[h] = self._edits(data[s:stop].split(None, 1)[0].decode("utf-8", "replace"))
                edits[k] = e
            per_word = edits[back]
            counts = np.zeros((rows, 3))
            for k in np.flatnonzero(per_word >= 0):
                r, s = int(row[k]), int(start[k])
                s += len(_LEAD.match(data[s : s + 64].decode("utf-8", "ignore")).group().encode())  # quotation marks before the word
                low, high = max(int(at[r]), s - self.model.settings.window), min(int(at[r + 1]), s + self.model.settings.window)
                quoted = is_quoted(data[low:s].decode("utf-8", "replace"), data[s:high].decode("utf-8", "replace"))
                counts[r, 2 if quoted else 0 if per_word[k] == 0 else 1] += 1
            n_words = np.bincount(row, minlength=rows)
            block = out[first : first + rows]
            block[:, 1], block[:, 2] = np.log1p(counts[:, 0]), counts[:, 0] > 0
            block[:, 3], block[:, 4] = np.log1p(counts[:, 1]), counts[:, 1] > 0
            block[:, 5] = np.log1p(counts[:, 2])
            block[:, 6] = 100 * counts[:, 0] / np.maximum(n_words, 20)
            block[:, 7] = np.log1p(n_words) / 10
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        weights = np.zeros(len(FEATURES))
        weights[: len(self.model.weights)] = self.model.weights
        return 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    settings: ToxicSettings = ToxicSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicModel:
    """Learn the lexicon and the weights. Pass only the rows that may be learned from."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(settings.sample_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("y", "text")

    @returning_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        n = [0, 0]
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {x for w in set((text or "").split()) for x in readings(w)}
                found |= {f"{w[:k]}*" for w in found for k in settings.stem_lengths if len(w) > k}
                seen.update(found)
                n[y > 0] += 1
                if y > 0:
                    toxic.update(found)
        grams = [*seen, "", " "]
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams), pa.array([*(seen[g] for g in seen), *n], pa.int64()), pa.array([*(toxic[g] for g in seen), 0, 0], pa.int64())],
            names=["gram", "n", "toxic"],
        )

    counted = sample.mapInArrow(count, "gram string, n long, toxic long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    of_class = F.col("gram").isin("", " ")  # the numbers of documents of each class, which no limit may cut
    kept = counted.where(of_class | ((F.col("toxic") >= settings.min_support) & (F.col("toxic") >= settings.purity * F.col("n"))))
    found = {r["gram"]: (r["n"], r["toxic"]) for r in kept.orderBy(F.desc(of_class), F.desc("toxic"), "gram").limit(4 * settings.max_terms + 2).collect()}
    clean, dirty = found.pop("", (0, 0))[0], found.pop(" ", (0, 0))[0]
    if not clean or not dirty:
        share = (dirty + 1e-9) / (clean + dirty + 1e-9) if dirty else 1e-9
        return ToxicModel(weights=(math.log(share / max(1 - share, 1e-9)),), settings=settings)

    def strength(gram: str) -> float:
        n, toxic = found[gram]
        return toxic * (math.log((toxic + 0.5) / (dirty + 1)) - math.log((n - toxic + 0.5) / (clean + 1)))

    stems = [g[:-1] for g in found if g.endswith("*") and found[g][1] >= settings.stem_support]
    stems = [s for s in stems if not any(s != t and s.startswith(t) for t in stems)]
    # A stem is worth its place only if it stands for several words.
    spread = {s: sum(1 for g in found if not g.endswith("*") and g.startswith(s)) for s in stems}
    stems = sorted((s for s in stems if spread[s] >= 3), key=lambda s: (-strength(s + "*"), s))[: settings.max_terms]
    terms = [g for g in found if not g.endswith("*") and not any(g.startswith(s) for s in stems)]
    terms = sorted(terms, key=lambda g: (-strength(g), g))[: settings.max_terms]
    model = ToxicModel(tuple(terms), tuple(stems), settings=settings)

    @returning_memory
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ToxicScorer(model)
        for batch in batches:
            x = scorer.features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"]
            )

    measured = sample.mapInArrow(measure, "y int, x array<double>").toPandas()  # bound: sample_rows
    x, y = np.array(measured["x"].tolist()), (measured["y"].to_numpy() > 0).astype(float)
    return ToxicModel(model.terms, model.stems, tuple(_fit_logistic(x, y).tolist()), settings)


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, abusive, misspelled, quoted): the score and the numbers of hits of each kind."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ToxicScorer(model)
        for batch in batches:
            x = scorer.features(batch.column(1))
            hits = [pa.array(np.rint(np.expm1(x[:, k])).astype(np.int64)) for k in (1, 3, 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer.scores(x)), *hits], names=[id_col, "score", "abusive", "misspelled", "quoted"]
            )

    return docs.select(id_col, F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {id_type}, score double, abusive bigint, misspelled bigint, quoted bigint"
    )


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    at = docs.columns.index(text_col)

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ToxicScorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(scorer.features(batch.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)
