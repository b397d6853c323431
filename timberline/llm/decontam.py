"""Benchmark decontamination by suffix arrays over training shards.

A shard is a slice of about 2 MB of training text inside a task. Its suffix array orders the
word sequences of the shard; every suffix of every benchmark item is binary-searched in it,
all suffixes at once, one word deeper in each step. A suffix that stays alive for a window's
length has a verbatim match at each position of its range. From the first matching place on, each match is
followed to its longest verbatim span (at the item's first place with that window), and the next
one is sought after it; so repeated words cost no pairs of places. Only runs of benchmark words at least as long as the
shortest window enter the suffix array: a window cannot lie anywhere else.

The benchmark is a stated query set. It is read in blocks of at most ``BLOCK_BYTES`` of text,
each broadcast alone; with several blocks the documents pass through one map step for each
block, without a shuffle.

Defined results: null and empty texts have no words and are not contaminated; an item without
words has no window; items with a null id count and are listed as an empty string; repeated
items with the same id are one item; repeated documents are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ROW, giving_back, nest, small_batches, unnest
from timberline.llm.words import ALNUM_LOWER, slices, split_words, text_buffers, words_of

WINDOW = 13
BLOCK_BYTES = 32 << 20  # benchmark text broadcast at once
PLACES = 1 << 20  # matching places held at once, unless one item has more
MIN_SHARE = 20  # contaminated if at least 1/20 of the words are hit
MATCH = pa.struct([("item", pa.string()), ("item_at", pa.int32()), ("at", pa.int32()), ("n", pa.int32())])
MATCH_SQL = "array<struct<item:string,item_at:int,at:int,n:int>>"


class TestSuffixes:
    """The suffixes of a block of benchmark items that are long enough to hold a window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = [i for i, _ in items]
        w = words_of([t for _, t in items], ALNUM_LOWER)
        self.vocab = np.unique(w.hash)
        self.words = np.searchsorted(self.vocab, w.hash).astype(np.int64) + 1
        n = w.counts
        need = np.minimum(n, window)
        item = w.text_of_word()
        at = np.arange(len(item)) - w.first[:-1][item]
        live = at + need[item] <= n[item]
        self.start = np.flatnonzero(live)
        self.item, self.at, self.need = item[live], at[live], need[item][live]
        self.end = w.first[1:][self.item]  # of the item's words
        self.shortest = int(need[n > 0].min()) if (n > 0).any() else 0


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``seq`` ordered by the words that follow, up to ``depth`` words (at least)."""
    order = np.argsort(seq, kind="stable")
    rank = np.zeros(len(seq), dtype=np.int64)
    rank[order[1:]] = np.cumsum(seq[order][1:] != seq[order][:-1])
    k = 1
    while k < depth and rank.max(initial=0) < len(seq) - 1:
        after = np.zeros(len(seq), dtype=np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (len(seq) + 1) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        k *= 2
    return order


def _narrow(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each word in its own sorted range of ``column``, all at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        v = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((v <= word) if right else (v < word))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def search(tests: TestSuffixes, seq: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, first, end) of every range of ``order`` whose places hold a whole window."""
    live = np.arange(len(tests.start))
    lo = np.zeros(len(live), dtype=np.int64)
    hi = np.full(len(live), len(order), dtype=np.int64)
    found = []
    d = 0
    while len(live):
        column = seq[np.minimum(order + d, len(seq) - 1)]
        column = np.where(order + d < len(seq), column, 0)
        word = tests.words[tests.start[live] + d]
        lo, hi = _narrow(column, lo, hi, word, False), _narrow(column, lo, hi, word, True)
        keep = lo < hi
        live, lo, hi = live[keep], lo[keep], hi[keep]
        d += 1
        whole = tests.need[live] == d
        if whole.any():
            found.append((live[whole], lo[whole], hi[whole]))
            live, lo, hi = live[~whole], lo[~whole], hi[~whole]
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none)


def places(tests: TestSuffixes, seq: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(test suffix, place in ``seq``) of the matches, some items at a time: for each item and place one suffix
    only, the item's first with that window, however often the window recurs in the item."""
    test, lo, hi = search(tests, seq, order)
    item = tests.item[test]
    by = np.lexsort((tests.at[test], lo, item))
    test, lo, hi, item = test[by], lo[by], hi[by], item[by]
    first = np.ones(len(test), dtype=bool)
    first[1:] = (item[1:] != item[:-1]) | (lo[1:] != lo[:-1])
    test, lo, n, item = test[first], lo[first], (hi - lo)[first], item[first]
    total = np.cumsum(n)
    begin = 0
    while begin < len(test):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PLACES, side="right")))
        while end < len(test) and item[end] == item[end - 1]:  # an item's places stay together
            end += 1
        size = n[begin:end]
        skip = np.repeat(lo[begin:end] - (np.cumsum(size) - size), size)
        yield np.repeat(test[begin:end], size), order[np.arange(int(size.sum())) + skip]
        begin = end


def _agree(a: np.ndarray, i: int, b: np.ndarray, j: int, most: int) -> int:
    """How many words of ``a`` from i on equal those of ``b`` from j on, up to ``most``."""
    n, step = 0, 64
    while n < most:
        size = min(step, most - n, len(a) - i - n, len(b) - j - n)
        if size <= 0:
            break
        differ = np.flatnonzero(a[i + n : i + n + size] != b[j + n : j + n + size])
        if len(differ):
            return n + int(differ[0])
        n, step = n + size, 2 * step
    return n


def match_texts(tests: TestSuffixes, data: np.ndarray, bounds: np.ndarray):
    """Word counts of consecutive texts, and their matches (text, item, item_at, at, n words)."""
    w = split_words(data, bounds, ALNUM_LOWER)
    none = np.zeros((0, 5), dtype=np.int64)
    if not len(tests.start) or not len(w.hash):
        return w.counts, none
    at = np.minimum(np.searchsorted(tests.vocab, w.hash), len(tests.vocab) - 1)
    ids = np.where(tests.vocab[at] == w.hash, at + 1, 0)
    # Runs of benchmark words inside one text.
    text = w.text_of_word()
    on = ids > 0
    new = on.copy()
    new[1:] &= ~on[:-1] | (text[1:] != text[:-1])
    run = np.cumsum(new) - 1
    size = np.bincount(run[on], minlength=int(new.sum()))
    on &= (size >= tests.shortest)[run] if len(size) else False
    pos = np.flatnonzero(on)
    if not len(pos):
        return w.counts, none
    # One sequence of all runs, with a stop (0) after each.
    fresh = np.concatenate([[False], run[pos[1:]] != run[pos[:-1]]])
    place = np.arange(len(pos)) + np.cumsum(fresh)
    seq = np.zeros(place[-1] + 2, dtype=np.int64)
    seq[place] = ids[pos]
    origin = np.zeros(len(seq), dtype=np.int64)
    origin[place] = pos
    order = suffix_array(seq, int(tests.need.max()))
    rows: list[tuple[int, int, int, int, int]] = []
    for test, where in places(tests, seq, order[seq[order] > 0]):
        by = np.lexsort((where, tests.item[test]))
        test, where = test[by].tolist(), where[by].tolist()
        reach = item = -1  # windows before ``reach`` lie inside the item's last span
        for k, at in zip(test, where, strict=True):
            if tests.item[k] == item and at < reach:
                continue
            item, begin = int(tests.item[k]), int(tests.start[k])
            n = _agree(seq, at, tests.words, begin, int(tests.end[k]) - begin)
            reach = at + n - int(tests.need[k]) + 1
            hit = int(origin[at])
            rows.append((int(text[hit]), item, int(tests.at[k]), hit - int(w.first[text[hit]]), n))
    return w.counts, np.array(rows, dtype=np.int64).reshape(-1, 5)


def _covered(spans: list[dict]) -> int:
    """Words covered by any of the spans."""
    total, reach = 0, 0
    for at, end in sorted((m["at"], m["at"] + m["n"]) for m in spans):
        total += max(0, end - max(at, reach))
        reach = max(reach, end)
    return total


def _matcher(shared) -> Callable:
    """Add the matches of one block of items to those found so far, and count the words hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for b in batches:
            data, bounds = text_buffers(b.column(ROW).field("text"))
            counts, own = np.zeros(b.num_rows, dtype=np.int64), [list(x or ()) for x in b.column("matches").to_pylist()]
            for lo, hi in slices(bounds):
                counts[lo:hi], rows = match_texts(tests, data, bounds[lo : hi + 1])
                for t, item, item_at, at, n in rows.tolist():
                    own[lo + t].append({"item": tests.ids[item], "item_at": item_at, "at": at, "n": n})
            yield pa.RecordBatch.from_arrays(
                [b.column(ROW), pa.array(counts, pa.int64()), pa.array(own, pa.list_(MATCH)),
                 pa.array([_covered(x) if x else 0 for x in own], pa.int64())], names=[ROW, "n_words", "matches", "n_hit"])

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most ``limit`` bytes of text (one item at least)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                            F.col("text").cast("string").alias("t")).where("t is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.t.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document's own columns (nested) with ``n_words``, ``n_hit`` (words covered by any
    window), ``matches`` (longest verbatim spans: item, place in item, place in text, words),
    ``items`` (sorted ids as strings) and ``contaminated``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = nest(docs)
    kind = rows.schema[ROW].dataType.simpleString()
    step = f"{ROW} {kind}, n_words long, matches {MATCH_SQL}, n_hit long"
    out = rows.withColumn("matches", F.array().cast(MATCH_SQL))
    for block in list(_blocks(benchmark, block_bytes)) or [[]]:
        tests = spark.sparkContext.broadcast(TestSuffixes(block, window))
        out = out.select(ROW, "matches").mapInArrow(giving_back(_matcher(tests)), step)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return out.withColumn("items", items).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return unnest(match(docs, benchmark).where(~F.col("contaminated")))
