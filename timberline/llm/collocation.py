"""Phrase collocations by FM-indexes over word ids, one for each shard of text.

A map step reads whole texts and fills shards of about ``SHARD_TOKENS`` words; a shard numbers its
distinct (lang, word) pairs and keeps its word numbers with a mark between pieces. Words below
``min_count`` in the whole corpus cannot be in a phrase, so each shard then replaces them by
the mark and builds its FM-index: the suffixes ordered by as many words as a phrase may have,
the Burrows-Wheeler column, and the LF mapping, which is C[c] + rank_c(i) for all places at once.

All phrases of one length are extended to the left together: a place i in the interval of P
whose preceding word is c lies at LF(i) in the interval of cP. There the other direction is
checked: cP is only kept if its first words (cP without P's last word) are frequent too, which
one flag at LF(i) tells, as intervals of longer phrases lie inside those of their beginnings.
Neighbouring places that came from one interval by one word are the interval of cP and their
number is its count in the shard. Shards send the counts of their phrases to buckets by the phrase's
hash, once for each shard however often a phrase occurs; a bucket sums them and answers the
shards with a bit for each phrase they sent: whether it reaches ``min_count``. Words, pairs and lengths up to ``STEPWISE`` words
are answered one after the other, the longer ones together. One shard for each frequent phrase
spells it at last, following the inverse of LF.

Scores, left and right extensions (longer phrases that begin or end with a phrase) and ranks
are joins and aggregates over the frequent phrases. A longer candidate as frequent as a
phrase inside it need only be sought one word to the left or right: all phrases between the two
have at least the count of the longer one.

Words are told apart by 64-bit hashes, phrases by their bucket and 48 bits of theirs. Tasks hold one shard, or the keys of one bucket.

Defined results: a null text is empty, a null lang is ``und``; repeated rows count each time;
empty tables give no phrases. Very long texts are cut into shards between pieces. Other
columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.blocks import joined, packed
from timberline.llm.common import land, nest, small_batches
from timberline.llm.decontam import suffix_array
from timberline.llm.words import SLICE, SPACED_LOWER, HashIndex, WordRule, mix, slices, split_words, text_buffers
from timberline.session import scratch_path

SHARD_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 20
MAX_BUCKETS = 50_000  # of the tables of shards
STEPWISE = 3
NO_LANG = "und"

_BREAKS = np.zeros(256, dtype=bool)  # bytes between pieces: . , ; : ! ? and line ends
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD = ~_BREAKS
_IN_WORD[[0x20, 0x09]] = False
_RULE = WordRule(_IN_WORD, SPACED_LOWER.code)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEFT = np.uint64(0x9E3779B97F4A7C15)


# --- shards of word numbers ------------------------------------------------------


def _ranges(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(bounds of texts or of parts of one text, first text, number of texts) of about ``size``
    bytes each; a text beyond that is cut after breaks."""
    for lo, hi in slices(bounds, size):
        if hi - lo > 1 or bounds[hi] - bounds[lo] <= 2 * size:
            yield bounds[lo : hi + 1], lo, hi - lo
            continue
        pos, end = int(bounds[lo]), int(bounds[hi])
        while pos < end:
            cut = min(pos + size, end)
            while cut < end:
                gap = np.flatnonzero(_BREAKS[data[cut : cut + size]])
                if len(gap):
                    cut += int(gap[0]) + 1
                    break
                cut = min(cut + size, end)
            yield np.array([pos, cut]), lo, 1
            pos = cut


class _Shard:
    """Word numbers (from 1) of consecutive pieces, 0 between pieces; the words by number."""

    def __init__(self) -> None:
        self.index = HashIndex()
        self.seq: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.langs: list[pa.Array] = []
        self.size = 0

    def add(self, data: np.ndarray, bounds: np.ndarray, langs: pa.Array, lang_hash: np.ndarray) -> None:
        w = split_words(data, bounds, _RULE)
        if not len(w.hash):
            return
        text = w.text_of_word()
        lo, hi = int(bounds[0]), int(bounds[-1])
        breaks = np.zeros(hi - lo + 1, dtype=np.int32)
        np.cumsum(_BREAKS[data[lo:hi]], out=breaks[1:])
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (breaks[w.start[1:] - lo] > breaks[w.end[:-1] - lo])
        number, spots = self.index.number_all(mix(w.hash + lang_hash[text]))
        seq = np.zeros(len(text) + int(new.sum()), dtype=np.int32)
        seq[np.arange(len(text)) + np.cumsum(new)] = number + 1
        self.seq.append(seq)
        self.size += len(seq)
        if len(spots):
            size = w.end[spots] - w.start[spots]
            edge = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(w.start[spots] - edge[:-1], size) + np.arange(int(edge[-1]))
            self.words.append(pa.StringArray.from_buffers(
                len(spots), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(_LOWER[data[at]])))
            self.langs.append(langs.take(pa.array(text[spots])))

    def row(self, shard: int) -> pa.RecordBatch:
        seq = joined(self.seq, np.int32)
        n = np.bincount(seq, minlength=len(self.index) + 1)[1:]
        words = pa.concat_arrays(self.words) if self.words else pa.array([], pa.string())
        langs = (pa.concat_arrays(self.langs) if self.langs else pa.array([], pa.string())).dictionary_encode()
        code = langs.indices.to_numpy()
        of_lang = np.bincount(code, weights=n, minlength=len(langs.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([len(seq)], pa.int64()), pa.array([_pack(seq)], pa.binary()),
             pa.array([packed(self.index.hashes)], pa.binary()), pa.array([_pack(n)], pa.binary()), _one_list(words),
             pa.array([_pack(code)], pa.binary()), _one_list(langs.dictionary), _one_list(pa.array(of_lang))],
            names=["shard", "size", "seq", "keys", "n", "words", "lang", "langs", "n_lang"])


_SHARD_SQL = ("shard long, size long, seq binary, keys binary, n binary, words array<string>, lang binary, "
              "langs array<string>, n_lang array<long>")


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _planes(a: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of the numbers, first bytes first, compressed; and how many they are."""
    raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(a).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _from_planes(value: pa.Scalar, width: int) -> np.ndarray:
    raw = value.as_py()
    n = int.from_bytes(raw[:8], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack(a: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32."""
    return _planes(a, 4)


def _unpack(value: pa.Scalar) -> np.ndarray:
    return _from_planes(value, 4).astype(np.int64)


def _keys(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _fill_shards(shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for b in batches:
            data, bounds = text_buffers(b.column(0))
            langs = b.column(1)
            names = langs.dictionary_encode()
            code = np.array([xxhash.xxh64_intdigest(x, seed=7) for x in names.dictionary.to_pylist()], dtype=np.uint64)
            code = code[names.indices.to_numpy()] if len(code) else code
            for cut, first, n in _ranges(data, bounds, SLICE):
                shard.add(data, cut, langs.slice(first, n), code[first : first + n])
                if shard.size >= shard_tokens:
                    yield shard.row(part | number)
                    number, shard = number + 1, _Shard()
        if shard.size:
            yield shard.row(part | number)

    return run


# --- the index of a shard ----------------------------------------------------------


class FMIndex:
    """Burrows-Wheeler column over word numbers (0: mark), good for phrases up to the depth
    that its suffixes were ordered by."""

    def __init__(self, bwt: np.ndarray, keys: np.ndarray):
        self.bwt = bwt
        self.keys = keys  # global hash of each word number, from 1
        self.psi = np.argsort(bwt, kind="stable")  # the place of each suffix's continuation
        self.lf = np.empty_like(self.psi)
        self.lf[self.psi] = np.arange(len(bwt))
        self.first = bwt[self.psi]

    @staticmethod
    def column(seq: np.ndarray, depth: int) -> np.ndarray:
        return seq[suffix_array(seq, depth) - 1]  # the sequence ends with a mark, which stands before its start

    def levels(self, known: Callable[[int, np.ndarray], np.ndarray | None], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, first place, count, hash) of the phrases of 2 to ``depth`` words. Where it is
        ``known`` which hashes of a length are frequent, only these are extended."""
        alive = self.first > 0
        run = np.zeros(len(alive), dtype=bool)
        run[:1] = True
        run[1:] = self.first[1:] != self.first[:-1]
        label = np.cumsum(run) - 1
        hashes = np.zeros(int(run.sum()), dtype=np.uint64)
        lo = np.flatnonzero(run)
        real = self.first[lo] > 0
        hashes[real] = self.keys[self.first[lo[real]] - 1]
        for k in range(2, depth + 1):
            place = np.flatnonzero(alive & (self.bwt > 0))
            to = self.lf[place]
            both = alive[to]  # the phrase without its last word is frequent as well
            origin = np.full(len(alive), -1, dtype=np.int64)
            origin[to[both]] = label[place[both]]
            run[1:] = (origin[1:] != origin[:-1]) | (self.first[1:] != self.first[:-1])
            lo = np.flatnonzero(run)
            label = np.cumsum(run) - 1
            n = np.diff(np.concatenate([lo, [len(alive)]]))
            found = origin[lo] >= 0
            grown = np.zeros(len(lo), dtype=np.uint64)
            grown[found] = mix(self.keys[self.first[lo[found]] - 1] * _LEFT + hashes[origin[lo[found]]] + np.uint64(k))
            hashes = grown
            yield k, lo[found], n[found], hashes[found]
            flags = known(k, hashes[found]) if k < depth else None
            if flags is not None:
                found[found] = flags
            alive = found[label]

    def spell(self, lo: np.ndarray, k: int) -> list[np.ndarray]:
        """Word numbers of the phrases of k words that begin at the given places."""
        out = []
        for _ in range(k):
            out.append(self.first[lo])
            lo = self.psi[lo]
        return out


def _dealt(hashes: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How hashes are sent: their order, the buckets there are, where each begins in the order (and the
    end), and the keys in order. The bucket and the key tell a phrase: words have all 64 bits as
    their key, phrases 48, as the buckets add bits of their own, the more the larger the corpus."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    key = hashes if k == 1 else hashes & np.uint64((1 << 48) - 1)
    order = np.lexsort((key, bucket))
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    return order, bucket[edge[:-1]], edge, key[order]


def _width(k: int) -> int:
    return 8 if k == 1 else 6


class _Answers:
    """Which of a shard's phrases are frequent, for lengths up to ``upto``, and the counts of those that it is to spell."""

    def __init__(self, table: pa.Table, buckets: int, upto: int):
        self.buckets, self.upto = buckets, upto
        self.rows: dict[int, dict[int, tuple]] = {}
        columns = (table[c] for c in ("k", "bucket", "bits", "at", "f"))
        for k, bucket, *rest in zip(*columns, strict=True):
            self.rows.setdefault(k.as_py(), {})[bucket.as_py()] = tuple(rest)

    def flags(self, k: int, hashes: np.ndarray) -> np.ndarray | None:
        return None if k > self.upto else self.read(k, hashes)[0]

    def read(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash whether it is frequent, and its count if this shard is to spell it (else 0)."""
        flags, f = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        mine = self.rows.get(k, {})
        if mine:
            order, bucket, edge, _ = _dealt(hashes, k, self.buckets)
            for b, lo, hi in zip(bucket.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b in mine:
                    bits, at, counts = mine[b]
                    own = order[lo:hi]
                    flags[own] = np.unpackbits(np.frombuffer(bits.as_buffer(), dtype=np.uint8), count=hi - lo)
                    f[own[at.values.to_numpy()]] = counts.values.to_numpy()
        return flags, f


def _build_index(shards: pa.Table, answers: pa.Table, depth: int, buckets: int) -> pa.Table:
    """The index row of a shard over its frequent words."""
    if not answers.num_rows or not shards.num_rows:
        return _INDEX.empty_table()
    keys = _keys(shards["keys"][0])
    flags, f = _Answers(answers, buckets, 1).read(1, keys)
    keep = np.flatnonzero(flags)
    number = np.zeros(len(keys) + 1, dtype=np.int64)
    number[keep + 1] = np.arange(1, len(keep) + 1)
    seq = np.concatenate([number[_unpack(shards["seq"][0])], [0]])
    seq = seq[np.concatenate([[True], (seq[1:] > 0) | (seq[:-1] > 0)])]
    words, code = shards["words"].combine_chunks().values, _unpack(shards["lang"][0])[keep]
    return pa.table([shards["shard"], pa.array([_pack(FMIndex.column(seq, depth))], pa.binary()), pa.array([packed(keys[keep])], pa.binary()),
                     _one_list(words.take(pa.array(keep))), _one_list(pa.array(f[keep])), pa.array([_pack(code)], pa.binary()),
                     shards["langs"]], schema=_INDEX)


_INDEX = pa.schema([("shard", pa.int64()), ("bwt", pa.binary()), ("keys", pa.binary()), ("words", pa.list_(pa.string())),
                    ("f", pa.list_(pa.int64())), ("lang", pa.binary()), ("langs", pa.list_(pa.string()))])
_INDEX_SQL = "shard long, bwt binary, keys binary, words array<string>, f array<long>, lang binary, langs array<string>"
_SENT = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("k", pa.int32()), ("hashes", pa.binary()), ("n", pa.binary())])
_SENT_SQL = "bucket long, shard long, k int, hashes binary, n binary"
_ANSWER = pa.schema([("shard", pa.int64()), ("k", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary()),
                     ("at", pa.list_(pa.int32())), ("f", pa.list_(pa.int64()))])
_ANSWER_SQL = "shard long, k int, bucket long, bits binary, at array<int>, f array<long>"
_PHRASE_SQL = "lang string, phrase string, k int, f long"
_PHRASE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])


def _index_of(row: pa.Table) -> FMIndex:
    return FMIndex(_unpack(row["bwt"][0]), _keys(row["keys"][0]))


def _sent(shard: int, k: int, hashes: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The counts of the phrases of k words of a shard, dealt to buckets. Lengths have buckets of their own.
    The keys of a bucket are sorted, so their differences are what is sent."""
    order, bucket, edge, key = _dealt(hashes, k, buckets)
    n = n[order]
    rows = [(k * buckets + b, shard, k, _planes(np.diff(key[lo:hi], prepend=np.uint64(0)), _width(k)), _pack(n[lo:hi]))
            for b, lo, hi in zip(bucket.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_SENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)


def _send_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield _sent(b["shard"][i].as_py(), 1, _keys(b["keys"][i]), _unpack(b["n"][i]), buckets)

    return run


def _send_pairs(buckets: int):
    """Phrases of two words: all words of an index are frequent, so no answer is needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(i, 1)])
                for k, _, n, hashes in _index_of(row).levels(_nothing, 2):
                    yield _sent(b["shard"][i].as_py(), k, hashes, n, buckets)

    return run


def _nothing(k: int, hashes: np.ndarray) -> None:
    """Nothing is known yet: all phrases are extended."""


def _send(lengths: range, buckets: int):
    """The phrases of these lengths in a shard whose shorter frequent phrases are known."""
    def run(index: pa.Table, answers: pa.Table) -> pa.Table:
        if not index.num_rows or not answers.num_rows:
            return _SENT.empty_table()
        known = _Answers(answers, buckets, lengths[0] - 1)
        return pa.Table.from_batches([_sent(index["shard"][0].as_py(), k, hashes, n, buckets)
                                      for k, _, n, hashes in _index_of(index).levels(known.flags, lengths[-1]) if k in lengths], schema=_SENT)

    return run


def _sum(min_count: int, buckets: int):
    """Sums of a bucket; each shard that has a frequent phrase gets a bit for every key it sent. The shard
    that is to spell a phrase, one of those that have it by its hash, gets its count."""
    def run(sent: pa.Table) -> pa.Table:
        k = sent["k"][0].as_py()
        parts = [np.cumsum(_from_planes(x, _width(k)), dtype=np.uint64) for x in sent["hashes"]]
        edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        keys, n = np.concatenate(parts), np.concatenate([_unpack(x) for x in sent["n"]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lo = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([lo, [len(keys)]]))
        total = np.add.reduceat(n[order], lo)
        frequent = total >= min_count
        flags = np.zeros(len(keys), dtype=bool)
        flags[order] = np.repeat(frequent, size)
        spells = order[(lo + (mix(keys[lo]) % size.astype(np.uint64)).astype(np.int64))[frequent]]
        f = np.zeros(len(keys), dtype=np.int64)
        f[spells] = total[frequent]
        rows = []
        for i, shard in enumerate(sent["shard"].to_pylist()):
            own = slice(edge[i], edge[i + 1])
            if flags[own].any():
                at = np.flatnonzero(f[own])
                rows.append((shard, k, sent["bucket"][i].as_py() - k * buckets, np.packbits(flags[own]).tobytes(), at.tolist(), f[own][at].tolist()))
        columns = zip(*rows, strict=True) if rows else [[]] * len(_ANSWER)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ANSWER, strict=True)], schema=_ANSWER)

    return run


def _spell(index: pa.Table, answers: pa.Table, depth: int, buckets: int) -> pa.Table:
    """The frequent phrases that this shard is to spell."""
    if not index.num_rows:
        return _PHRASE.empty_table()
    words, langs = index["words"].combine_chunks().values, index["langs"].combine_chunks().values
    lang = _unpack(index["lang"][0])
    f = index["f"].combine_chunks().values.to_numpy()
    found = [(1, [np.flatnonzero(f)], f[f > 0])]
    if answers.num_rows:
        fm, known = _index_of(index), _Answers(answers, buckets, min(depth, STEPWISE))  # as they were sent
        for k, lo, _, hashes in fm.levels(known.flags, depth):
            f = known.read(k, hashes)[1]
            found.append((k, [x - 1 for x in fm.spell(lo[f > 0], k)], f[f > 0]))
    return pa.concat_tables(
        pa.table([langs.take(pa.array(lang[numbers[0]])), pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in numbers], " "),
                  pa.array(np.full(len(f), k, np.int32)), pa.array(f)], schema=_PHRASE) for k, numbers, f in found)


# --- the corpus -------------------------------------------------------------------------


def phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, shard_tokens: int = SHARD_TOKENS,
            bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame]:
    """Exact counts: ``lang, phrase, k, f`` of all phrases of 1 to ``max_words`` words that
    occur ``min_count`` times, and ``lang, n`` (all word occurrences)."""
    small_batches(docs.sparkSession)
    rows = nest(docs).select(F.coalesce(F.col("row__.text").cast("string"), F.lit("")).alias("text"),
                             F.coalesce(F.col("row__.lang").cast("string"), F.lit(NO_LANG)).alias("lang"))
    kept = _Buckets(docs)
    try:
        return _phrases(kept, rows, min_count, max_words, shard_tokens, bucket_keys)
    finally:
        kept.drop()


class _Buckets:
    """Tables bucketed by shard: what goes to a shard is shuffled to where its row lies, the row itself is
    written once and never moves. The files are in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.number = min(MAX_BUCKETS, max(8, 4 * docs.rdd.getNumPartitions()))
        self.names: list[str] = []

    def table(self, rows: DataFrame, name: str) -> DataFrame:
        self.names.append(f"{name}_{uuid.uuid4().hex}")
        rows.write.format("parquet").bucketBy(self.number, "shard").sortBy("shard") \
            .option("path", scratch_path(self.spark, self.names[-1])).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _phrases(kept: _Buckets, rows: DataFrame, min_count: int, max_words: int, shard_tokens: int,
             bucket_keys: int) -> tuple[DataFrame, DataFrame]:
    shards = kept.table(rows.mapInArrow(_fill_shards(shard_tokens), _SHARD_SQL), "phrase_shards")
    sizes = land(shards.select(F.explode(F.arrays_zip("langs", "n_lang")).alias("x")).groupBy(F.col("x.langs").alias("lang"))
                 .agg(F.sum("x.n_lang").alias("n")), "phrase-sizes")
    buckets = max(1, (shards.agg(F.sum("size")).first()[0] or 0) // bucket_keys)

    def answer(sent: DataFrame) -> DataFrame:
        return land(sent.groupBy("bucket").applyInArrow(_sum(min_count, buckets), _ANSWER_SQL), "phrase-answers")

    known = answer(shards.select("shard", "keys", "n").mapInArrow(_send_words(buckets), _SENT_SQL))
    index = kept.table(shards.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(
        lambda a, b: _build_index(a, b, max_words, buckets), _INDEX_SQL), "phrase_index")
    places = index.select("shard", "bwt", "keys")
    answers = answer(places.mapInArrow(_send_pairs(buckets), _SENT_SQL))
    steps = [range(k, k + 1) for k in range(3, min(STEPWISE, max_words) + 1)]
    steps += [range(STEPWISE + 1, max_words + 1)] if max_words > STEPWISE else []
    for lengths in steps:
        sent = places.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_send(lengths, buckets), _SENT_SQL)
        answers = answers.union(answer(sent))
    spelt = index.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        lambda a, b: _spell(a, b, max_words, buckets), _PHRASE_SQL)
    return land(spelt, "phrases"), sizes


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def extensions(counted: DataFrame) -> DataFrame:
    """``lang, phrase, left, right``: the highest count of the phrases that add one word before or after."""
    words, k, one = F.split("phrase", " "), F.col("k"), F.lit(1)
    grown = counted.where("k >= 3").select("lang", F.explode(F.array(
        F.struct(_part(words, F.lit(2), k - 1).alias("phrase"), F.col("f").alias("left"), F.lit(None).cast("long").alias("right")),
        F.struct(_part(words, one, k - 1).alias("phrase"), F.lit(None).cast("long").alias("left"), F.col("f").alias("right")))).alias("x"))
    return grown.select("lang", "x.*").groupBy("lang", "phrase").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000,
                 inside_percent: int = 100, **shape) -> DataFrame:
    """The first ``top`` phrases of each lang by score: ``lang, rank, phrase, a, l, r, n, score``
    and the extension counts ``left, right`` (null: none frequent). A phrase goes if a longer one
    that holds it has at least ``inside_percent`` of its count."""
    counted, sizes = phrases(docs, min_count, max_words, **shape)
    found = counted.where("k >= 2").join(extensions(counted), ["lang", "phrase"], "left")
    longer = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0)))
    found = found.where(100 * longer < inside_percent * F.col("f")).withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("head", _part(words, F.lit(1), F.col("cut"))).withColumn(
        "tail", _part(words, F.col("cut") + 1, F.col("k") - F.col("cut")))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counted.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(sizes, "lang")
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("top", (exact["a"] * exact["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")) \
        .withColumn("bottom", exact["l"] * exact["r"]).withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase", "a", "n", "left", "right").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score", "left", "right") \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "left", "right")
