"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its letter n-grams of one to three letters with word edges, lower-cased
and hashed into a fixed number of buckets. Their embeddings are averaged and a linear softmax
names the language; embeddings and weights are trained by stochastic gradient descent in numpy
on a bounded sample of labelled rows (about ``SAMPLE_PER_LANG`` rows of each language by a hash of their id,
texts up to ``SAMPLE_BYTES``). A held-back part of the sample calibrates the scores by one
temperature; texts whose calibrated score is below ``min_score`` are marked ``rejected``.

The trained embeddings and weights are multiplied into one table of bucket scores for each
language, so prediction over whole texts is a sum of table entries, all in array operations.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
labelled row every text is ``und``; rows with a null lang are not learned from; repeated rows
are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ROW, nest, small_batches
from timberline.llm.words import mix, slices, text_buffers

BUCKETS = 1 << 16
DIM = 16
EPOCHS = 6
RATE = 0.5
SAMPLE_PER_LANG = 1500
SAMPLE_BYTES = 20_000
MIN_SCORE = 0.5
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_LEAD = (np.arange(256) & 0xC0) != 0x80


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, 0 for everything else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (0xD800 <= c < 0xE000) or not (s := chr(c)).isalpha():
            continue
        low = s.lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (0: none) of consecutive texts, and each text's first code point."""
    body = data[bounds[0] : bounds[-1]]
    points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(body) + 1, dtype=np.int64)
    np.cumsum(_LEAD[body], out=lead[1:])
    return _letters()[points], lead[bounds - bounds[0]]


def subwords(letters: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams around each code point, and where they count: the middle must be
    a letter, neighbours outside the word or the text are edges."""
    x = letters.astype(np.uint64)
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    prev[1:], nxt[:-1] = x[:-1], x[1:]
    inner = first[(first > 0) & (first < len(x))]
    prev[inner] = 0
    nxt[inner - 1] = 0
    if order == 1:
        key = x
    elif order == 2:
        key = x | (nxt << np.uint64(21))
    else:
        key = prev | (x << np.uint64(21)) | (nxt << np.uint64(42))
    key = (key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS, x > 0


class Model:
    """Bucket scores by language, bias, temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.table, self.bias, self.temperature = langs, np.ascontiguousarray(table.T), bias, temperature

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each language for each text, and the number of its subwords."""
        letters, first = code_points(data, bounds)
        total = np.zeros((len(bounds) - 1, len(self.langs)))
        n = np.zeros(len(bounds) - 1)
        for order in ORDERS:
            bucket, ok = subwords(letters, first, order)
            bucket = bucket[ok]
            edge = np.concatenate([[0], np.cumsum(ok)])[first]
            n += np.diff(edge)
            for k, column in enumerate(self.table):
                c = np.concatenate([[0.0], np.cumsum(column[bucket], dtype=np.float64)])
                total[:, k] += c[edge[1:]] - c[edge[:-1]]
        return total / np.maximum(n, 1)[:, None] + self.bias, n

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their share of its subwords."""
    letters, first = code_points(*text_buffers(pa.array([text])))
    parts = []
    for order in ORDERS:
        bucket, ok = subwords(letters, first, order)
        parts.append(bucket[ok])
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    """Stochastic gradient descent over the texts, then a temperature from every fifth text."""
    langs = sorted(set(labels))
    bags = [(ids, w, langs.index(y)) for (ids, w), y in zip(map(bag, texts), labels, strict=True) if len(ids)]
    if not bags:
        return None
    held = bags[::5] if len(bags) >= 50 else []
    fit = [b for i, b in enumerate(bags) if i % 5] if held else bags
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (len(langs), DIM)).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    steps = EPOCHS * len(fit)
    for step in range(steps):
        if step % len(fit) == 0:
            order = rng.permutation(len(fit))
        ids, w, y = fit[order[step % len(fit)]]
        rate = RATE * (1 - step / steps) + 1e-3
        mean = w @ emb[ids]
        z = out @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = p @ out
        out -= rate * np.outer(p, mean)
        bias -= rate * p
        # Scaled by the number of subwords as in averaging: rare buckets still move.
        emb[ids] -= (rate * 20) * w[:, None] * back[None, :]
    model = Model(langs, emb @ out.T, bias)
    if held:
        z = np.stack([w @ (emb[ids] @ out.T) + bias for ids, w, _ in held])
        y = np.array([b[2] for b in held])
        grid = np.geomspace(0.05, 5, 60)

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

        model.temperature = float(min(grid, key=loss))
    return model


def span(text: Column, doc_id: Column) -> Column:
    """A text of at most SAMPLE_BYTES itself, of a longer one a part of a quarter as many characters."""
    size = SAMPLE_BYTES // 4
    at = F.pmod(F.xxhash64(doc_id, F.lit(5)), F.greatest(F.char_length(text) - size, F.lit(0)) + 1) + 1
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, text).otherwise(F.substring(text, at.cast("int"), F.lit(size)))


def sample(docs: DataFrame, learn: Column, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """About ``per_lang`` labelled rows of each language, chosen by a hash of their id: a narrow
    count of each language gives the share to take, so no language is gathered in one place. Of a text beyond
    SAMPLE_BYTES a part is learned from, at a place that a hash of the id chooses."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if counts.count() <= 10_000:  # one row for each language
        counts = F.broadcast(counts)
    taken = F.pmod(F.xxhash64("doc_id"), F.col("n")) < per_lang
    rows = known.select("doc_id", "text", "lang").join(counts, "lang").where(taken).drop("n")
    return rows.withColumn("text", span(F.col("text"), F.col("doc_id")))


def _predictor(shared, min_score: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, bounds = text_buffers(b.column(1))
            pred: list[str] = []
            score: list[float] = []
            for lo, hi in slices(bounds, 1 << 20):
                if model is None:
                    pred += [UNKNOWN] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                logits, n = model.logits(data, bounds[lo : hi + 1])
                p = model.scores(logits)
                best = p.argmax(axis=1)
                pred += [model.langs[k] if has else UNKNOWN for k, has in zip(best.tolist(), (n > 0).tolist(), strict=True)]
                score += np.where(n > 0, p[np.arange(len(best)), best], 0.0).tolist()
            rejected = pa.array([s < min_score for s in score], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), rejected],
                                             names=[ROW, "lang_pred", "score", "rejected"])

    return run


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """Train on the bounded sample of rows for which ``learn`` holds."""
    rows = sample(docs, learn).select("doc_id", "text", "lang").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """Each document's own columns (nested) with ``lang_pred``, ``score`` and ``rejected``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = nest(docs).select(ROW, F.col(f"{ROW}.text").cast("string").alias("text"))
    kind = rows.schema[ROW].dataType.simpleString()
    return rows.mapInArrow(_predictor(spark.sparkContext.broadcast(model), min_score),
                           f"{ROW} {kind}, lang_pred string, score double, rejected boolean")
