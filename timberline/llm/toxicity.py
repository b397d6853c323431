"""Toxicity by a misspelling-tolerant lexicon and context windows.

The lexicon is learned from labelled rows: words, and stems that stand for any continuation,
that mark toxic texts and hardly occur in clean ones. It is stored as a trie; a Levenshtein
automaton runs over the trie (a state is a set of trie nodes with the edits spent so far),
determinised as it is used, so a word is looked up in one step for each letter however many
terms there are. Matches become features of the text: exact and misspelled ones, their weights
and density, and, from a window of words around each, whether the term is quoted rather than
used. A logistic model over the features gives the score.

The sample is bounded: ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled rows by hash order, texts
up to ``SAMPLE_BYTES``. Prediction reads whole texts.

Defined results: null and empty texts score as texts without a match; rows without a label are
not learned from; several labels of one doc_id count as toxic if any is; without a toxic label
every score is 0; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ROW, nest, small_batches
from timberline.llm.words import SPACED, HashIndex, slices, split_words, text_buffers

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
SAMPLE_BYTES = 20_000
MAX_TERMS = 400
COVER = 8  # terms wanted in each toxic text of the sample
STEMS = (4, 5, 6)  # letters of the stems tried
WINDOW = 8  # words on either side that decide on quotation
REMEMBER = 1_000_000  # distinct words a Python worker remembers
#: Quotation marks that open, with those that close them; straight marks do both.
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "”": "”", "\"": "\"", "`": "`"}
STRAIGHT = "\"`”»"  # tell by the words they touch whether they open
APOSTROPHES = "’‘`"  # no marks between two letters
FEATURES = ("exact", "fuzzy", "quoted", "weight", "density", "distinct")
_FIRST = regex.compile(r"[\p{L}\p{N}]")
_LAST = regex.compile(r"(?r)[\p{L}\p{N}]")
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def core(word: str) -> str:
    """A word as the lexicon sees it: lower case, without punctuation at its ends."""
    word = word.lower()
    first = _FIRST.search(word)
    return word[first.start() : _LAST.search(word).end()] if first else ""


def allowed(term: str) -> int:
    """Edits that still count as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automaton over a trie of terms, determinised lazily.

    ``terms`` maps a term (a stem ends in ``*``) to the edits allowed for it."""

    def __init__(self, terms: dict[str, int]):
        self.terms = list(terms)
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.budget: list[int] = [0]  # most edits allowed by any term below the node
        self.limit = [terms[t] for t in self.terms]
        self.stem = [t.endswith("*") for t in self.terms]
        for i, t in enumerate(self.terms):
            node = 0
            self.budget[0] = max(self.budget[0], self.limit[i])
            for c in t.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.budget.append(0)
                node = self.child[node][c]
                self.budget[node] = max(self.budget[node], self.limit[i])
            self.ends[node].append(i)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []  # (term, edits) if a word ends here
        self.sticky: list[tuple[int, int] | None] = []  # the same for any continuation
        self.start = self._state({0: 0}, None)

    def _state(self, spent: dict[int, int], stuck: tuple[int, int] | None) -> int:
        """Number of the state with these edits spent at these nodes, closed under letters that
        the word leaves out."""
        todo = list(spent.items())
        while todo:
            node, e = todo.pop()
            if spent.get(node, 9) < e:
                continue
            for n in self.child[node].values():
                if e + 1 <= self.budget[n] and e + 1 < spent.get(n, 9):
                    spent[n] = e + 1
                    todo.append((n, e + 1))
        best = stuck
        for node, e in spent.items():
            for i in self.ends[node]:
                if self.stem[i] and e <= self.limit[i] and (best is None or (e, i) < (best[1], best[0])):
                    best = (i, e)
        key = frozenset((*spent.items(), (-1, best)))
        if key not in self.states:
            final = best
            for node, e in spent.items():
                for i in self.ends[node]:
                    if e <= self.limit[i] and (final is None or (e, i) < (final[1], final[0])):
                        final = (i, e)
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.final.append(final)
            self.sticky.append(best)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        spent: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < spent.get(node, 9):
                spent[node] = e

        for node, e in self.sets[state]:
            if node == -1:
                continue
            put(node, e + 1)
            for letter, n in self.child[node].items():
                put(n, e if letter == c else e + 1)
        return self._state(spent, self.sticky[state])

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term the word is a spelling of."""
        if len(self.sets) > 200_000:
            self.__init__(dict(zip(self.terms, self.limit, strict=True)))
        state = self.start
        for c in word:
            step = self.next[state].get(c)
            if step is None:
                step = self.next[state][c] = self._step(state, c)
            state = step
            if len(self.sets[state]) == 1:  # no live node: only a stem met before can count
                break
        return self.final[state]


def learn_terms(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Terms and stems with their log-odds: taken one by one, each time the one that reaches
    most toxic texts not yet covered ``COVER`` times, against its clean texts."""
    def grams(text: str) -> set[str]:
        own = {c for w in set(_WORD.findall(text)) if 3 <= len(c := core(w)) <= 40}
        return own | {w[:k] + "*" for w in own for k in STEMS if len(w) > k}

    marked = Counter(g for t, y in zip(texts, toxic, strict=True) if y for g in grams(t))
    have: dict[str, set[int]] = {g: set() for g, n in marked.items() if n >= 2}
    del marked
    clean: Counter = Counter()
    for i, (t, y) in enumerate(zip(texts, toxic, strict=True)):
        for g in grams(t):
            if g in have:
                if y:
                    have[g].add(i)
                else:
                    clean[g] += 1
    n_toxic, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))

    def odds(g: str) -> float:
        return math.log(((len(have[g]) + 0.5) / (n_toxic + 1)) / ((clean[g] + 0.5) / (n_clean + 1)))

    good = {g: odds(g) for g in have if clean[g] * n_toxic <= 0.05 * len(have[g]) * n_clean and odds(g) >= 2.5}
    times = Counter()
    out: dict[str, float] = {}
    live = {g: len(have[g]) for g in good}
    while live and len(out) < MAX_TERMS:
        # Counts only fall, so the head of a stale order is checked again before it is taken.
        g = max(live, key=lambda g: (live[g], not g.endswith("*"), len(g), g))
        now = sum(1 for i in have[g] if times[i] < COVER)
        if now < live[g]:
            if now >= 2:
                live[g] = now
            else:
                del live[g]
            continue
        if now < 2:
            break
        out[g] = good[g]
        del live[g]
        times.update(have[g])
    return out


class Lexicon:
    """The learned terms, their automaton, and the edits that proved safe on clean texts."""

    def __init__(self, weights: dict[str, float], limits: dict[str, int]):
        self.weights, self.limits = weights, limits

    def automaton(self) -> Automaton:
        return Automaton(self.limits)


class Scanner:
    """Features of texts; remembers which words match which term."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = lexicon.automaton()
        self.weight = np.array([lexicon.weights[t] for t in self.automaton.terms] or [0.0])
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex()
        self.term = np.zeros(0, dtype=np.int32)
        self.edits = np.zeros(0, dtype=np.int32)

    def matches(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Term (-1: none) and edits of every word."""
        if len(self.index) > REMEMBER:
            self.forget()
        number, spots = self.index.number_all(w.hash)
        if len(spots):
            find = self.automaton.match
            got = []
            for a, b in zip(w.start[spots].tolist(), w.end[spots].tolist(), strict=True):
                got.append(find(core(w.data[a:b].tobytes().decode())) or (-1, 0))
            got = np.array(got, dtype=np.int32).reshape(-1, 2)
            self.term = np.concatenate([self.term, got[:, 0]])
            self.edits = np.concatenate([self.edits, got[:, 1]])
        return self.term[number], self.edits[number]

    def features(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        w = split_words(data, bounds, SPACED)
        term, edits = self.matches(w)
        hit = np.flatnonzero(term >= 0)
        n = len(bounds) - 1
        out = np.zeros((n, len(FEATURES)))
        if not len(hit):
            return out
        text = np.searchsorted(w.first, hit, side="right") - 1
        exact = edits[hit] == 0
        quoted = np.array([self._quoted(w, i, t) for i, t in zip(hit.tolist(), text.tolist(), strict=True)])
        use = ~quoted
        out[:, 0] = np.log1p(np.bincount(text[exact & use], minlength=n))
        out[:, 1] = np.log1p(np.bincount(text[~exact & use], minlength=n))
        out[:, 2] = np.log1p(np.bincount(text[quoted], minlength=n))
        np.maximum.at(out[:, 3], text, self.weight[term[hit]] / 5 / (1 + edits[hit]))
        out[:, 4] = np.minimum(1.0, 50 * np.bincount(text[use], minlength=n) / np.maximum(1, w.counts))
        pairs = np.unique(text * len(self.weight) + term[hit])
        out[:, 5] = np.log1p(np.bincount(pairs // len(self.weight), minlength=n))
        return out

    @staticmethod
    def _quoted(w, i: int, t: int) -> bool:
        """Whether word i stands between quotation marks that open and close within the window."""
        lo, hi = max(int(w.first[t]), i - WINDOW), min(int(w.first[t + 1]), i + WINDOW + 1)
        before = w.data[w.start[lo] : w.start[i]].tobytes().decode()
        own = w.data[w.start[i] : w.end[i]].tobytes().decode()
        after = w.data[w.end[i] : w.end[hi - 1]].tobytes().decode()
        first = _FIRST.search(own)
        return quotation(before + own + after, len(before) + (first.start() if first else 0))


def quotation(text: str, at: int) -> bool:
    """Whether a quotation that opens before ``at`` closes after it."""
    open_: list[str] = []  # what closes the quotations that are open at ``at``
    for i, c in enumerate(text):
        if c not in PAIRS and c != "’":
            continue
        left, right = i > 0 and text[i - 1].isalnum(), i + 1 < len(text) and text[i + 1].isalnum()
        if left and right and c in APOSTROPHES:
            continue
        if i >= at:
            if any(c in closes for closes in open_):
                return True
            continue
        closes = bool(open_) and c in open_[-1]
        if c in STRAIGHT and left != right:  # a mark that touches one word opens before and closes after it
            closes = closes and left
            opens = right
        else:
            opens = c in PAIRS and not closes
        if closes:
            open_.pop()
        elif opens:
            open_.append(PAIRS[c])
    return False


class Model:
    """Lexicon and logistic weights over the features."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.weights + self.bias)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient descent with a small penalty; weights keep the signs given (0: free)."""
    weights, bias = np.zeros(x.shape[1]), -2.0
    for step in range(3000):
        p = 1 / (1 + np.exp(-(x @ weights + bias)))
        rate = 1.0 if step < 2000 else 0.3
        weights -= rate * (x.T @ (p - y) / len(y) + 1e-4 * weights)
        weights = np.where((sign > 0) & (weights < 0), 0.0, weights)
        bias -= rate * float(np.mean(p - y))
    return weights, bias


def train(texts: list[str], toxic: list[int]) -> Model | None:
    """Learn the lexicon, the edits each term tolerates, and the weights of the features."""
    if not texts or not sum(toxic):
        return None
    weights = learn_terms(texts, toxic)
    limits = {t: allowed(t.rstrip("*")) for t in weights}
    y = np.array(toxic)
    # A term keeps its tolerance only if its misspellings hardly reach clean texts.
    trial = Automaton(limits)
    reach = {t: [0, 0] for t in limits}
    for t, label in zip(texts, toxic, strict=True):
        got = {m for w in set(_WORD.findall(t)) if (m := trial.match(core(w))) and m[1]}
        for i, _ in got:
            reach[trial.terms[i]][label] += 1
    for t, (bad, good) in reach.items():
        if bad > 1 and bad > 0.05 * good:
            limits[t] = 0
    lexicon = Lexicon(weights, limits)
    scanner = Scanner(lexicon)
    data, bounds = text_buffers(pa.array(texts))
    x = np.concatenate([scanner.features(data, bounds[lo : hi + 1]) for lo, hi in slices(bounds)])
    w, b = _fit_logistic(x, y, np.array([1, 1, 0, 1, 1, 1]))
    return Model(lexicon, w, b)


def span(text: Column, doc_id: Column) -> Column:
    """What is learned from a text: all of it, or of one beyond SAMPLE_BYTES a part of a quarter as many
    characters, at a place that a hash of the id chooses."""
    size = SAMPLE_BYTES // 4
    at = F.pmod(F.xxhash64(doc_id, F.lit(5)), F.greatest(F.char_length(text) - size, F.lit(0)) + 1) + 1
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, text).otherwise(F.substring(text, at.cast("int"), F.lit(size)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """Train on a bounded sample of the labelled rows for which ``learn`` (of doc_id) holds."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(learn)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = marked.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(
        marked.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", span(F.col("text"), F.col("doc_id")).alias("text"))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids are broadcast, and one row of each id is learned from.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], [r.toxic for r in rows])


def _scorer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scanner = Scanner(model.lexicon) if model else None
        for b in batches:
            data, bounds = text_buffers(b.column(1))
            parts = [model.scores(scanner.features(data, bounds[lo : hi + 1])) if model else np.zeros(hi - lo)
                     for lo, hi in slices(bounds)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=[ROW, "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Each document's own columns (nested) with its ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = nest(docs).select(ROW, F.col(f"{ROW}.text").cast("string").alias("text"))
    kind = rows.schema[ROW].dataType.simpleString()
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), f"{ROW} {kind}, score double")
