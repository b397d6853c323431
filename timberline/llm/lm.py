"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

Counts of every training token are gathered from the whole corpus. The ``TOP`` most frequent
words and the end of a text are classes of their own; all other words share classes by their
first byte and last letters. The network predicts a token's class from the classes of the two
tokens before it: context vectors through position matrices, a dot product with the class
vector, and a bias. A word's probability is its class's probability times its smoothed share
of the class, which leaves room for one unseen word in each class, so the probabilities of all
words sum to one.

Training covers every training text once, or all texts of a small block equally often: each
block of documents trains a copy from the same start by minibatches with shared noise samples,
and the copies are averaged by their tokens, in two levels. Class probabilities are exact: one batched matrix product over all class contexts
gives the normaliser of each (at most ``(TOP + 258)**2`` numbers), and scoring adds them up.

Defined results: null and empty texts are their end token alone; without training rows the base
score uses N = V = 0 and the model's is equal shares; rows with a null doc_id are learned from;
repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.blocks import deal, ids, into_blocks, joined, packed, table, unpacked
from timberline.llm.common import land
from timberline.llm.words import SPACED_LOWER, HashIndex, Words, mix, per_text, slices, split_words, text_buffers

TOP = 512
GROUPS = 256
DIM = 16
NOISE = 32
BATCH = 1024
RATE = 0.15
MIN_STEPS = 600  # minibatches of a block; a small block is read several times
TRAIN_SLICE = 16 << 20  # bytes of a block's training texts split into words at once
BLOCK_ROWS = 4096
CLASSES = 1 + TOP + GROUPS
_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[list(b".,;:!?\"')]}")] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_GROUP_MASK = np.uint64(GROUPS - 1)

COUNTS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
COUNTS_SQL = "bucket int, block int, keys binary, counts binary"
TOTALS_SQL = ("block int, keys binary, counts binary, top array<struct<key:long,c:long>>, "
              "groups array<struct<g:int,n:long,v:long>>")


def keys_of(w: Words) -> np.ndarray:
    """Word keys: 56 bits of the word's hash, and in the low bits its group (by first byte, last
    two letters and whether punctuation follows)."""
    if not len(w.hash):
        return w.hash
    last = w.end - 1
    trail = _TRAIL[w.data[last]]
    end = np.where(trail & (last > w.start), last - 1, last)
    shape = (_LOW[w.data[end]].astype(np.uint64) | (_LOW[w.data[np.maximum(end - 1, w.start)]].astype(np.uint64) << np.uint64(8))
             | (_LOW[w.data[w.start]].astype(np.uint64) >> np.uint64(6) << np.uint64(16)))
    group = (mix(shape) & (_GROUP_MASK >> np.uint64(1))) << np.uint64(1) | trail.astype(np.uint64)
    return (w.hash & ~_GROUP_MASK) | group


def _counter(buckets: int) -> Callable:
    """A block's distinct words (held-out ones too: they ask for their counts) and training counts."""

    def run(t: pa.Table) -> pa.Table:
        data, bounds = text_buffers(t["text"])
        train = t["train"].to_numpy()
        index, counts = HashIndex(), np.zeros(0, dtype=np.int64)
        for lo, hi in slices(bounds):
            w = split_words(data, bounds[lo : hi + 1], SPACED_LOWER)
            number, _ = index.number_all(keys_of(w))
            counts = np.concatenate([counts, np.zeros(len(index) - len(counts), dtype=np.int64)])
            counts += np.bincount(number[train[lo:hi][w.text_of_word()]], minlength=len(counts))
        block = t["block"][0].as_py()
        rows = [(b, block, k, c) for b, k, c in deal(index.hashes, buckets, counts)]
        return table(rows, COUNTS)

    return run


def _totals(t: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's words: an answer for each block, and the bucket's share of
    the most frequent words and of the groups' sums."""
    blocks = t["block"].to_pylist()
    keys, counts = unpacked(t["keys"], np.uint64), unpacked(t["counts"], np.int64)
    distinct, inverse = np.unique(joined(keys, np.uint64), return_inverse=True)
    total = np.bincount(inverse, weights=joined(counts, np.int64), minlength=len(distinct)).astype(np.int64)
    out_block, out_keys, out_counts, at = [], [], [], 0
    for b, k in zip(blocks, keys, strict=True):
        c = total[inverse[at : at + len(k)]]
        at += len(k)
        out_block.append(b)
        out_keys.append(packed(k[c > 0]))
        out_counts.append(packed(c[c > 0]))
    first = np.argsort(-total, kind="stable")[:TOP]
    top = [{"key": int(k), "c": int(c)} for k, c in zip(distinct[first].view(np.int64), total[first], strict=True) if c]
    group = (distinct & _GROUP_MASK).astype(np.int64)
    n = np.bincount(group, weights=total, minlength=GROUPS).astype(np.int64)
    v = np.bincount(group[total > 0], minlength=GROUPS)
    sums = [{"g": g, "n": int(n[g]), "v": int(v[g])} for g in range(GROUPS) if v[g]]
    more = len(out_block)
    return pa.table({
        "block": pa.array([*out_block, -1], pa.int32()), "keys": pa.array([*out_keys, b""], pa.binary()),
        "counts": pa.array([*out_counts, b""], pa.binary()),
        "top": pa.array([[]] * more + [top], pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int64())]))),
        "groups": pa.array([[]] * more + [sums], pa.list_(pa.struct([("g", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])))})


@dataclass
class Vocabulary:
    """What scoring needs to know of all counts, besides those of a block's own words."""

    keys: np.ndarray  # uint64, the most frequent words, sorted
    counts: np.ndarray  # their counts
    group_n: np.ndarray  # tokens of each group's other words
    group_v: np.ndarray  # distinct ones
    texts: int  # training texts, the count of the end token
    tokens: int  # N
    types: int  # V

    def classes(self, keys: np.ndarray) -> np.ndarray:
        """0: end; 1 to TOP: frequent words; after them the groups."""
        group = (keys & _GROUP_MASK).astype(np.int64) + 1 + TOP
        if not len(self.keys):
            return group
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, group)

    def class_share(self) -> np.ndarray:
        """Unigram probability of each class."""
        n = np.full(CLASSES, 0.5)
        n[0] += self.texts
        n[1 : 1 + len(self.keys)] += self.counts
        n[1 + TOP :] += self.group_n
        return n / n.sum()


def vocabulary(totals: DataFrame, texts: int) -> Vocabulary:
    top = totals.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("c"), "key").limit(TOP).collect()
    groups = totals.select(F.explode("groups").alias("g")).select("g.*").groupBy("g").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    keys = np.array([r.key for r in top], dtype=np.int64).view(np.uint64)
    counts = np.array([r.c for r in top], dtype=np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    n, v = np.zeros(GROUPS, dtype=np.int64), np.zeros(GROUPS, dtype=np.int64)
    for r in groups:
        n[r.g], v[r.g] = r.n, r.v
    tokens, types = int(n.sum()) + texts, int(v.sum()) + (texts > 0)
    own = (keys & _GROUP_MASK).astype(np.int64)
    np.subtract.at(n, own, counts)
    np.subtract.at(v, own, 1)
    return Vocabulary(keys, counts, n, v, texts, tokens, types)


def _minibatches(parts: Iterator[tuple], rng: np.random.Generator) -> Iterator[list[np.ndarray]]:
    """``BATCH`` tokens at a time of parts ``(target, one, two, passes)``, each part in random
    order; what a part leaves over begins the next one's first minibatch."""
    rest = [np.zeros(0, dtype=np.int64)] * 3
    for *tokens, passes in parts:
        order = np.concatenate([rng.permutation(len(tokens[0])) for _ in range(passes)])
        lo = 0
        if len(rest[0]):
            lo = min(len(order), BATCH - len(rest[0]))
            rest = [np.concatenate([r, x[order[:lo]]]) for r, x in zip(rest, tokens, strict=True)]
            if len(rest[0]) < BATCH:
                continue
            yield rest
        for lo in range(lo, len(order) - BATCH + 1, BATCH):
            yield [x[order[lo : lo + BATCH]] for x in tokens]
        lo = len(order) - (len(order) - lo) % BATCH
        rest = [x[order[lo:]] for x in tokens]
    if len(rest[0]):
        yield rest


class Network:
    """Log-bilinear network over classes; all parameters in one float32 array."""

    SHAPES = {"r": (CLASSES, DIM), "q": (CLASSES, DIM), "c1": (DIM, DIM), "c2": (DIM, DIM), "b": (CLASSES,)}

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), dtype=np.float32))
        net.r[:] = rng.normal(0, 0.3, net.r.shape)
        net.q[:] = rng.normal(0, 0.05, net.q.shape)
        net.c1[:] = np.eye(DIM) * 0.7
        net.c2[:] = np.eye(DIM) * 0.3
        net.b[:] = np.log(share)
        return net

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] @ self.c1 + self.r[two] @ self.c2

    def train(self, parts: Iterator[tuple], share: np.ndarray, seed: int) -> None:
        """Random minibatches over the tokens of all parts: tell each from shared noise."""
        rng = np.random.default_rng(seed)
        log_noise = np.log(NOISE * share).astype(np.float32)
        reach = np.cumsum(share)
        seen = np.full_like(self.flat, 1e-2)
        grad = Network(np.zeros_like(self.flat))

        def scatter(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(at, weights=rows[:, d], minlength=CLASSES) for d in range(DIM)], axis=1)

        for w, a, b in _minibatches(parts, rng):
            noise = np.minimum(np.searchsorted(reach, rng.random(NOISE)), CLASSES - 1)
            ra, rb = self.r[a], self.r[b]
            u = ra @ self.c1 + rb @ self.c2
            qw, qn = self.q[w], self.q[noise]
            real = 1 / (1 + np.exp(-((u * qw).sum(axis=1) + self.b[w] - log_noise[w])))
            fake = 1 / (1 + np.exp(-(u @ qn.T + self.b[noise] - log_noise[noise])))
            m = np.float32(1 / len(w))
            g = ((real - 1) * m).astype(np.float32)
            h = (fake * m).astype(np.float32)
            du = g[:, None] * qw + h @ qn
            grad.q[:] = scatter(w, g[:, None] * u)
            np.add.at(grad.q, noise, h.T @ u)
            grad.b[:] = np.bincount(w, weights=g, minlength=CLASSES)
            np.add.at(grad.b, noise, h.sum(axis=0))
            grad.r[:] = scatter(a, du @ self.c1.T) + scatter(b, du @ self.c2.T)
            grad.c1[:] = ra.T @ du
            grad.c2[:] = rb.T @ du
            seen += grad.flat**2
            self.flat -= RATE * grad.flat / np.sqrt(seen)

    def normalisers(self, one: np.ndarray) -> np.ndarray:
        """Natural log of the summed scores over all classes, for these first and all second contexts."""
        out = np.empty((len(one), CLASSES), dtype=np.float32)
        second = self.r @ self.c2
        for k, c in enumerate(one.tolist()):
            z = (self.r[c] @ self.c1 + second) @ self.q.T + self.b
            top = z.max(axis=1)
            out[k] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        return out


def _tokens(w: Words, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens (an end after each text) and of the two before each; where the
    words are among the tokens, and each text's first token."""
    texts = len(w.first) - 1
    place = np.arange(len(w.hash)) + w.text_of_word()
    first = w.first + np.arange(texts + 1)
    target = np.zeros(len(w.hash) + texts, dtype=np.int64)
    target[place] = voc.classes(keys_of(w))
    one, two = np.zeros_like(target), np.zeros_like(target)
    one[1:] = target[:-1]  # the end of the text before stands for this one's start
    two[2:] = target[:-2]
    two[first[:-1]] = 0
    two[np.minimum(first[:-1] + 1, len(two) - 1)[np.diff(first) > 1]] = 0
    return target, one, two, place, first


def _parts(data: np.ndarray, bounds: np.ndarray, voc: Vocabulary) -> tuple[int, Iterator[tuple]]:
    """The number of a block's tokens, and the parts ``Network.train`` reads: all texts once, or as often as the whole block
    needs for ``MIN_STEPS``. A block of several slices is cut into equal ones."""
    texts, size = len(bounds) - 1, int(bounds[-1] - bounds[0])
    n = max(1, -(-size // TRAIN_SLICE))
    cuts = np.unique(np.searchsorted(bounds, bounds[0] + np.arange(1, n) * (size / n))).tolist()
    edges = [0, *[c for c in cuts if 0 < c < texts], texts]
    spans = list(zip(edges[:-1], edges[1:], strict=True)) if texts else []

    def words(lo: int, hi: int) -> Words:
        return split_words(data, bounds[lo : hi + 1], SPACED_LOWER)

    def passes(total: int) -> int:
        return max(1, -(-MIN_STEPS * BATCH // max(1, total)))

    if len(spans) == 1:
        tokens = _tokens(words(*spans[0]), voc)[:3]
        total = len(tokens[0])
        return total, iter([(*tokens, passes(total))])
    total = sum(len(words(*s).hash) + s[1] - s[0] for s in spans)
    return total, ((*_tokens(words(*s), voc)[:3], 1) for _ in range(passes(total)) for s in spans)


def _trainer(shared) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        voc, start, share = shared.value
        net, block = Network(start.copy()), t["block"][0].as_py()
        data, bounds = text_buffers(t.filter(t["train"])["text"])
        n, parts = _parts(data, bounds, voc)
        net.train(parts, share, seed=block * 1009)
        return pa.table({"block": pa.array([block], pa.int32()), "n": pa.array([n], pa.int64()),
                         "net": pa.array([packed(net.flat.astype(np.float32))], pa.binary())})

    return run


def _average(t: pa.Table) -> pa.Table:
    n = t["n"].to_numpy()
    total = sum(x.astype(np.float64) * k for x, k in zip(unpacked(t["net"], np.float32), n.tolist(), strict=True))
    mean = (total / max(1, int(n.sum()))).astype(np.float32)
    return pa.table({"block": pa.array([0], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()),
                     "net": pa.array([packed(mean)], pa.binary())})


class Scorer:
    """Log10 probabilities of texts, given the counts of their words."""

    def __init__(self, voc: Vocabulary, net: Network, normal: np.ndarray):
        self.voc, self.net, self.normal = voc, net, normal
        self.first, self.second = net.r @ net.c1, net.r @ net.c2

    def score(self, data: np.ndarray, bounds: np.ndarray, index: HashIndex, counts: np.ndarray) -> dict[str, np.ndarray]:
        voc = self.voc
        w = split_words(data, bounds, SPACED_LOWER)
        target, one, two, place, first = _tokens(w, voc)
        keys = keys_of(w)
        number = index.find(keys)
        c = np.where(number >= 0, counts[np.maximum(number, 0)] if len(counts) else 0, 0)
        count = np.full(len(target), voc.texts, dtype=np.int64)
        count[place] = c
        base = np.log10((count + 0.5) / (voc.tokens + 0.5 * (voc.types + 1)))
        logit = np.einsum("ij,ij->i", self.first[one] + self.second[two], self.net.q[target]) + self.net.b[target]
        model = (logit - self.normal[one, two]).astype(np.float64) / np.log(10)
        group = target - 1 - TOP
        rare = group >= 0
        g = group[rare]
        model[rare] += np.log10((count[rare] + 0.5) / (voc.group_n[g] + 0.5 * (voc.group_v[g] + 1)))

        def by_text(x):
            s = np.concatenate([[0.0], np.cumsum(x)])
            return s[first[1:]] - s[first[:-1]]

        return {"n_tokens": np.diff(first), "n_known": per_text(count > 0, first), "base_score": by_text(base), "score": by_text(model)}


def _scored(shared) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        voc, flat, normal = shared.value
        scorer = Scorer(voc, Network(flat), normal)
        index = HashIndex()
        index.add(joined(unpacked(right["keys"], np.uint64), np.uint64))
        counts = joined(unpacked(right["counts"], np.int64), np.int64)
        data, bounds = text_buffers(left["text"])
        parts = [scorer.score(data, bounds[lo : hi + 1], index, counts) for lo, hi in slices(bounds)]
        out = {"doc_id": left["doc_id"], "held_out": left["held_out"]}
        for name in ("n_tokens", "n_known"):
            out[name] = pa.array(joined([p[name] for p in parts], np.int64), pa.int64())
        out["train_tokens"] = pa.array(np.full(left.num_rows, voc.tokens), pa.int64())
        for name in ("base_score", "score"):
            out[name] = pa.array(joined([p[name] for p in parts], np.float64), pa.float64())
        return pa.table(out)

    return run


def _normaliser(shared) -> Callable:
    def run(batches):
        net = Network(shared.value[1])
        for b in batches:
            one = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(x) for x in net.normalisers(one)], pa.binary())],
                                             names=["one", "row"])

    return run


def score(docs: DataFrame, held_out: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Train on the documents for which ``held_out`` (of doc_id) is not true, and score all:
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    rows, n_blocks = into_blocks(docs, block_rows)
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumn("train", ~F.col("held_out"))
    texts = rows.where("train").count()
    counts = rows.select("block", "text", "train").groupBy("block").applyInArrow(_counter(n_blocks), COUNTS_SQL)
    totals = land(counts.groupBy("bucket").applyInArrow(_totals, TOTALS_SQL), "lm-counts")
    voc = vocabulary(totals, texts)
    share = voc.class_share()
    shared = spark.sparkContext.broadcast((voc, Network.start(share).flat, share))
    trained = rows.select("block", "text", "train").groupBy("block").applyInArrow(_trainer(shared), "block int, n long, net binary")
    first = trained.groupBy(F.pmod("block", F.lit(max(1, int(n_blocks**0.5)))).alias("part")).applyInArrow(_average, "block int, n long, net binary")
    mean = first.groupBy("block").applyInArrow(_average, "block int, n long, net binary").collect()
    flat = np.frombuffer(mean[0].net, dtype=np.float32).copy() if mean and mean[0].n else Network.start(share).flat
    model = spark.sparkContext.broadcast((voc, flat))
    parts = spark.range(0, CLASSES, 1, min(CLASSES, spark.sparkContext.defaultParallelism)).mapInArrow(_normaliser(model), "one long, row binary").collect()
    normal = np.stack([np.frombuffer(r.row, dtype=np.float32) for r in sorted(parts, key=lambda r: r.one)])
    model = spark.sparkContext.broadcast((voc, flat, normal))
    answers = totals.where("block >= 0").select("block", "keys", "counts")
    return rows.select("block", "doc_id", "text", "held_out").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
