"""Substring dedup by suffix automata of reference shards.

A word window that occurs in several documents stays in the first of them and is removed from
the others. A block of documents streams through a suffix automaton of its reference shard: the
passages of earlier documents that the block's own documents repeat. Matching statistics give,
at each word, the longest run of words that occurs in the shard; where it reaches the window
length and the window's first document is an earlier one, the window's words are removed, so
overlapping windows remove maximal spans.

A broadcast of the whole corpus as reference has no size bound, so each block gets its shard by
shuffle, and only passages that can match enter one:

1. every block sends the distinct minimizers of its windows (the least hash among the short
   grams of a window; equal windows have equal minimizers) to buckets, which answer with those
   that another document has too;
2. windows whose minimizer is shared send their hash and first document; the answer names each
   window's first document, and asks that document's block for the passage;
3. the blocks of first documents send the passages, joined over consecutive windows;
4. each block builds the automata of its shard, ``SHARD_WORDS`` words at a time, and streams
   its documents.

A key reaches a bucket once from each block however often it occurs, and a passage reaches a
block once, so a passage that a third of all documents share costs one row for each block.

Defined results: null and empty texts have no words; texts shorter than a window keep all;
windows repeated inside one document, or in rows with the same doc_id, stay; a null doc_id is
later than any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.blocks import BLOCK_ROWS, deal, ids, into_blocks, joined, packed, table, unpacked
from timberline.llm.words import SPACED, HashIndex, Words, slices, split_words, spread, text_buffers

WINDOW = 13
GRAM = 6
SHARD_WORDS = 50_000

KEYS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("many", pa.binary())])
KEYS_SQL = "bucket int, block int, keys binary, docs binary, many binary"
NEED, OWN = 0, 1
ANSWERS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
ANSWERS_SQL = "block int, kind int, keys binary, values binary"
SPANS_SQL = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<at:int,n:int>>"
PASSAGE = 2


class SuffixAutomaton:
    """Suffix automaton over the words of passages, built one word at a time."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, passage: list[bytes]) -> None:
        """Add a passage; matches do not run across passages."""
        step, link, length = self.next, self.link, self.length
        last = 0
        for c in passage:
            known = step[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._clone(last, c, known)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: bytes, q: int) -> int:
        step, link, length = self.next, self.link, self.length
        new = len(step)
        step.append(step[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest run ending there that occurs in a passage."""
        step, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in words:
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def windows_of(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions at which windows begin, the windows' hashes and minimizers."""
    hashes, ok = w.windows(window)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, hashes[:0], hashes[:0]
    grams, _ = w.windows(gram)
    least = grams[: len(grams) - (window - gram)].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, grams[j : len(grams) - (window - gram) + j], out=least)
    return at, hashes[at], least[at]


def _grouped(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first document of each, and whether it has several."""
    if not len(keys):
        return keys, docs, np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    least, most = np.minimum.reduceat(docs, head), np.maximum.reduceat(docs, head)
    return keys[head], least, least != most


def _each_slice(t: pa.Table) -> Iterator[tuple[int, Words, np.ndarray]]:
    data, bounds = text_buffers(t["text"])
    docs = ids(t["doc_id"])
    for lo, hi in slices(bounds):
        yield lo, split_words(data, bounds[lo : hi + 1], SPACED), docs[lo:hi]


def _send(t: pa.Table, keys: list[np.ndarray], docs: list[np.ndarray], buckets: int) -> pa.Table:
    k, least, many = _grouped(joined(keys, np.uint64), joined(docs, np.int64))
    block = t["block"][0].as_py()
    return table([(b, block, *rest) for b, *rest in deal(k, buckets, least, many)], KEYS)


def _minimizers(window: int, gram: int, buckets: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        keys, docs = [], []
        for _, w, doc in _each_slice(t):
            at, _, least = windows_of(w, window, gram)
            own = doc[w.text_of_word()[at]]
            # Neighbouring windows mostly share their minimizer: one of each run will do.
            new = np.ones(len(at), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
            keys.append(least[new])
            docs.append(own[new])
        return _send(t, keys, docs, buckets)

    return run


def _shared_minimizers(t: pa.Table) -> pa.Table:
    """Answer each block with its keys that some other document has too."""
    blocks, keys = t["block"].to_pylist(), unpacked(t["keys"], np.uint64)
    first = joined(unpacked(t["docs"], np.int64), np.int64)
    distinct, inverse = np.unique(joined(keys, np.uint64), return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    most = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, first)
    np.maximum.at(most, inverse, first)
    many = np.zeros(len(distinct), dtype=bool)
    many[inverse[joined(unpacked(t["many"], bool), bool)]] = True
    shared = (many | (least != most))[inverse]
    rows, at = [], 0
    for b, k in zip(blocks, keys, strict=True):
        rows.append((b, NEED, packed(k[shared[at : at + len(k)]]), b""))
        at += len(k)
    return table(rows, ANSWERS)


def _known(answers: pa.Table, kind: int) -> pa.Table:
    return answers.filter(pc.equal(answers["kind"], kind))


def _candidates(window: int, gram: int, buckets: int) -> Callable:
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], KEYS)
        index = HashIndex()
        index.add(joined(unpacked(answers["keys"], np.uint64), np.uint64))
        keys, docs = [], []
        for _, w, doc in _each_slice(t):
            at, hashes, least = windows_of(w, window, gram)
            on = index.find(least) >= 0
            keys.append(hashes[on])
            docs.append(doc[w.text_of_word()[at[on]]])
        return _send(t, keys, docs, buckets)

    return run


def _first_documents(t: pa.Table) -> pa.Table:
    """Tell each block the first document of its windows that have an earlier one than some
    document of the block, and that document's block who asked."""
    blocks = np.array(t["block"].to_pylist(), dtype=np.int64)
    keys = unpacked(t["keys"], np.uint64)
    asker = np.repeat(blocks, [len(k) for k in keys])
    key = joined(keys, np.uint64)
    doc = joined(unpacked(t["docs"], np.int64), np.int64)
    many = joined(unpacked(t["many"], bool), bool)
    order = np.lexsort((asker, doc, key))
    key, doc, asker, many = key[order], doc[order], asker[order], many[order]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    owner, holder = doc[first][group], asker[first][group]
    need = many | (doc > owner)
    rows = []
    for kind, to, value, on in ((NEED, asker, owner, need), (OWN, holder, asker, need & (asker != holder))):
        by = np.flatnonzero(on)
        by = by[np.argsort(to[by], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1], [True]])) if len(by) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows.append((int(to[by[a]]), kind, packed(key[by[a:b]]), packed(value[by[a:b]])))
    return table(rows, ANSWERS)


def _passages(w: Words, starts: np.ndarray, window: int) -> list[bytes]:
    """Texts of the windows that begin at these words, consecutive ones joined."""
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    out = []
    for run in np.split(starts, cut):
        a, b = int(run[0]), int(run[-1]) + window
        spans = zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)
        out.append(b" ".join(w.data[x:y].tobytes() for x, y in spans))
    return out


def _owned(window: int, gram: int) -> Callable:
    """The passages that other blocks asked for, from the documents of this block."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return table([], ANSWERS)
        key = joined(unpacked(answers["keys"], np.uint64), np.uint64)
        asker = joined(unpacked(answers["values"], np.int64), np.int64)
        index = HashIndex()
        index.add(np.unique(key))
        number = index.find(key)
        order = np.argsort(number, kind="stable")
        asker, first = asker[order], np.searchsorted(number[order], np.arange(len(index) + 1))
        open_ = np.ones(len(index), dtype=bool)  # keys not met yet: one place of each is enough
        out: dict[int, list[bytes]] = {}
        for _, w, _doc in _each_slice(t):
            at, hashes, _ = windows_of(w, window, gram)
            got = index.find(hashes)
            on = np.flatnonzero(got >= 0)
            on = on[open_[got[on]]]
            _, one = np.unique(got[on], return_index=True)
            on = on[one]
            open_[got[on]] = False
            n = first[got[on] + 1] - first[got[on]]
            place = np.repeat(at[on], n)
            who = asker[np.repeat(first[got[on]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            by = np.lexsort((place, who))
            place, who = place[by], who[by]
            for block in np.unique(who).tolist():
                a, b = np.searchsorted(who, (block, block + 1))
                out.setdefault(block, []).extend(_passages(w, place[a:b], window))
        return table([(b, PASSAGE, b"", b"\n".join(p)) for b, p in out.items()], ANSWERS)

    return run


def _shards(passages: list[bytes]) -> Iterator[SuffixAutomaton]:
    """Automata of the passages, ``SHARD_WORDS`` words at a time (one passage at least)."""
    shard, n = SuffixAutomaton(), 0
    for p in passages:
        words = p.split(b" ")
        if n and n + len(words) > SHARD_WORDS:
            yield shard
            shard, n = SuffixAutomaton(), 0
        shard.add(words)
        n += len(words)
    if n:
        yield shard


def _removed(window: int, gram: int) -> Callable:
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        need = _known(answers, NEED)
        index = HashIndex()
        index.add(joined(unpacked(need["keys"], np.uint64), np.uint64))
        owner = joined(unpacked(need["values"], np.int64), np.int64)
        parts = list(_each_slice(t)) if t.num_rows else []
        passages = {p for x in _known(answers, PASSAGE)["values"].to_pylist() for p in x.split(b"\n")}
        own_docs = np.concatenate([d for _, _, d in parts]) if parts else np.zeros(0, np.int64)
        local = np.isin(owner, own_docs)  # first documents that may be in this block
        jobs, open_ = [], np.ones(len(owner), dtype=bool)
        for _, w, doc in parts:
            at, hashes, _ = windows_of(w, window, gram)
            got = index.find(hashes)
            at, got = at[got >= 0], got[got >= 0]
            mine = doc[w.text_of_word()[at]]
            home = local[got] & open_[got] & (mine == owner[got])
            _, one = np.unique(got[home], return_index=True)
            open_[got[home][one]] = False
            if len(one):
                passages.update(_passages(w, at[home][one], window))
            later = owner[got] < mine
            jobs.append((w, at[later], np.zeros(len(w.hash), dtype=bool)))
        # Runs of windows to be checked, as words, once for all shards.
        runs = []
        for w, at, hit in jobs:
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                a, b = int(run[0]), int(run[-1]) + window
                spans = zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)
                runs.append((hit, a, [w.data[x:y].tobytes() for x, y in spans]))
        for shard in _shards(sorted(passages)):
            for hit, a, words in runs:
                n = np.array(shard.matching(words))[window - 1 :]
                hit[a : a + len(n)] |= n >= window
        rows = []
        for (_, w, _doc), (_, at, hit) in zip(parts, jobs, strict=True):
            judged = np.zeros(len(hit), dtype=bool)
            judged[at] = True  # windows between two runs have no earlier document
            gone = spread(hit & judged, window)
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                rows.append(_document(w, gone, a, b))
        n_words, n_removed, kept, spans = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
        return pa.table({"doc_id": t["doc_id"].cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))})

    return run


def _document(w: Words, gone: np.ndarray, a: int, b: int) -> tuple[int, int, str, list[dict]]:
    """A document's words, words removed, kept text (words joined by a space) and removed spans."""
    if a == b:
        return 0, 0, "", []
    out = gone[a:b]
    if not out.any():
        return b - a, 0, b" ".join(w.data[w.start[a] : w.end[b - 1]].tobytes().split()).decode(), []
    spans = zip(w.start[a:b][~out].tolist(), w.end[a:b][~out].tolist(), strict=True)
    kept = b" ".join(w.data[x:y].tobytes() for x, y in spans).decode()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
    return b - a, int(out.sum()), kept, [{"at": int(x), "n": int(y - x)} for x, y in edge.reshape(-1, 2)]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words, joined by one space) and the removed
    ``spans`` (first word, words), a row for each document."""
    rows, blocks = into_blocks(docs, block_rows)
    by_block = rows.groupBy("block")
    sent = by_block.applyInArrow(_minimizers(window, gram, blocks), KEYS_SQL)
    shared = sent.groupBy("bucket").applyInArrow(_shared_minimizers, ANSWERS_SQL)
    asked = by_block.cogroup(shared.groupBy("block")).applyInArrow(_candidates(window, gram, blocks), KEYS_SQL)
    answers = asked.groupBy("bucket").applyInArrow(_first_documents, ANSWERS_SQL)
    own, need = answers.where(F.col("kind") == OWN), answers.where(F.col("kind") == NEED)
    passages = by_block.cogroup(own.groupBy("block")).applyInArrow(_owned(window, gram), ANSWERS_SQL)
    known = need.unionByName(passages)
    return by_block.cogroup(known.groupBy("block")).applyInArrow(_removed(window, gram), SPANS_SQL)


def kept_digest(found: DataFrame) -> DataFrame:
    """The removal result with the kept text as its SHA-256."""
    return found.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")

