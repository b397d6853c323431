"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``max_bits`` of each other share a 64-bit value that lies within half
that distance of both. Every distinct fingerprint emits all variants within half the radius;
variants meet in a shuffle and fingerprints that share one are checked and linked. The shuffle
key is a variant's leading bits (a cell): a fingerprint is sent once to each cell that holds
variants of it, and the variants themselves are laid out there, sorted and compared. Cells
with many variants (one page template, large near-copy groups) are cut by further bits, those that divide their
own members best, until their parts fit.

Fingerprints in one variant group are all within ``max_bits`` of its inner members (those
within the smaller half), so a link from each member to one inner member loses no connection
and no group is expanded into pairs. Exact copies are one fingerprint throughout.

Defined results: null and empty texts have fingerprint 0, linked like any other; fewer words
than a shingle: the whole sequence is the one shingle; repeated rows share a component; a null
doc_id never becomes a component id unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from timberline.llm.common import giving_back, land, nest, small_batches, unnest
from timberline.llm.components import components
from timberline.llm.words import SPACED_LOWER, slices, split_words, text_buffers
from timberline.session import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
CELL_VARIANTS = 2_000_000  # variants laid out in one cell, about
TASK_VARIANTS = 12_000_000  # variants laid out in a task at once
GROUP = ["cell", "mask", "sub"]  # a cell, and the bits and their values that a part of it has in common
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's word shingles, and the number of shingles of each text."""
    w = split_words(data, bounds, SPACED_LOWER)
    n = w.counts
    size = w.end - w.start
    place = np.cumsum(size + 1) - (size + 1)  # each word with one space after it
    joined = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    source = np.repeat(w.start - place, size) + (spots := np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
    joined[spots] = _LOWER[data[source]]
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    first = w.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + k, w.first[1:][text]) - 1
    buf, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(place[first].tolist(), (place + size)[last].tolist(), strict=True)
    return np.fromiter((digest(buf[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(first)), count


def fingerprint_texts(data: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if more than half of its shingles set it."""
    h, count = shingle_hashes(data, bounds, k)
    out = np.zeros(len(count), dtype=np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    ones = np.zeros((len(full), 64), dtype=np.int64)
    first = (np.cumsum(count) - count)[full]
    owner = np.repeat(np.arange(len(full)), count[full])
    for lo in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[lo : lo + (1 << 16)]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    assert len(first) == len(full)
    packed = np.packbits(ones * 2 > count[full][:, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return out


def _fingerprinter(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_buffers(b.column(1))
            parts = [fingerprint_texts(data, bounds[lo : hi + 1], k) for lo, hi in slices(bounds)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: a row for each document, the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)
    rows = nest(docs).select("row__.doc_id", F.col("row__.text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(_fingerprinter(shingle)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def flips(positions: list[int], at_most: int) -> list[tuple[int, int]]:
    """(mask, bits set) of all ways to flip up to ``at_most`` of the given bits."""
    return [(sum(1 << p for p in c), r) for r in range(at_most + 1) for c in combinations(positions, r)]


def ball(free: int, at_most: int) -> int:
    """Variants of up to ``at_most`` flips of ``free`` bits."""
    return sum(comb(free, r) for r in range(at_most + 1))


@lru_cache(maxsize=4096)
def _flips_of(mask: int, at_most: int) -> list[tuple[int, int]]:
    return flips([p for p in range(64) if mask >> p & 1], at_most)


def _splitter(radius: int) -> Callable:
    """Send the members of a crowded group on to the parts of it that hold variants of theirs: a part
    is named by the variants' values of the bits in ``add`` as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, add, sub = (b.column(c).to_numpy().view(np.uint64) for c in ("fp", "add", "sub"))
            used, cell, mask = (b.column(c).to_numpy() for c in ("used", "cell", "mask"))
            kinds, kind = np.unique(np.stack([add, used.astype(np.uint64)], axis=1), axis=0, return_inverse=True)
            for i, (bits, u) in enumerate(kinds.tolist()):
                own = np.flatnonzero(kind.ravel() == i)
                for flip, r in _flips_of(bits, radius - u):
                    value = sub[own] | ((fp[own] ^ np.uint64(flip)) & np.uint64(bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[own]), pa.array(mask[own] | np.uint64(bits).view(np.int64)), pa.array(value.view(np.int64)),
                         pa.array(np.full(len(own), u + r, np.int32)), pa.array(fp[own].view(np.int64))],
                        names=["cell", "mask", "sub", "used", "fp"])

    return run


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node it is linked to, directly or not."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_cell(fp: np.ndarray, used: np.ndarray, free: tuple[int, ...], max_bits: int,
              limit: int = TASK_VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group: lay out the variants over the ``free`` bits, find fingerprints that share
    one, check their distance, and return (fingerprint, a linked one). Beyond ``limit``
    variants the two values of the most balanced bit are done one after the other."""
    radius = (max_bits + 1) // 2
    fp, first = np.unique(fp, return_index=True)
    used = used[first]
    if free and sum(int(n) * ball(len(free), radius - u) for u, n in enumerate(np.bincount(used))) > limit:
        ones = np.array([np.count_nonzero(fp >> np.uint64(p) & np.uint64(1)) for p in free])
        best = int(np.minimum(ones, len(fp) - ones).argmax())
        if 0 < ones[best] < len(fp):
            value = (fp >> np.uint64(free[best]) & np.uint64(1)).astype(np.int64)
            parts = []
            for v in (0, 1):
                reach = used + (value != v)
                own = reach <= radius
                parts.append(link_cell(fp[own], reach[own], free[:best] + free[best + 1 :], max_bits, limit))
            return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    return _link_variants(fp, used, free, max_bits)


def _link_variants(fp: np.ndarray, used: np.ndarray, free: tuple[int, ...], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    radius, inner_radius = (max_bits + 1) // 2, max_bits // 2
    room = sum(1 << p for p in free)
    low = fp & np.uint64(room)
    variants, owner, inner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
    for u in range(radius + 1):
        own = np.flatnonzero(used == u)
        if not len(own):
            continue
        ways = _flips_of(room, radius - u)
        masks = np.array([m for m, _ in ways], dtype=np.uint64)
        dist = np.array([r for _, r in ways]) + u
        variants.append((low[own][:, None] ^ masks[None, :]).ravel())
        owner.append(np.repeat(own.astype(np.int32), len(masks)))
        inner.append(np.tile(dist <= inner_radius, len(own)))
    v, owner, inner = np.concatenate(variants), np.concatenate(owner), np.concatenate(inner)
    order = np.argsort(v)
    v = v[order]
    same = v[1:] == v[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(v) else np.zeros(0, bool)
    if not shared.any():
        return fp[:0], fp[:0]
    v, order = v[shared], order[shared]
    owner, inner = owner[order].astype(np.int64), inner[order]
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.concatenate([head, [len(v)]]))
    centre = np.repeat(np.minimum.reduceat(np.where(inner, owner, len(fp)), head), size)
    real = (centre < len(fp)) & (centre != owner)
    pairs = np.unique(centre[real] * len(fp) + owner[real])
    a, b = pairs // len(fp), pairs % len(fp)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
    least = _least(len(fp), a[near], b[near])
    linked = np.flatnonzero(least != np.arange(len(fp)))
    return fp[linked], fp[least[linked]]


def _linker(bits: int, max_bits: int) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        mask = t["mask"][0].as_py() & (1 << 64) - 1
        free = tuple(p for p in range(64 - bits) if not mask >> p & 1)
        a, b = link_cell(t["fp"].to_numpy().view(np.uint64), t["used"].to_numpy(), free, max_bits)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return run


def _bits_to_add(groups: DataFrame, crowded: DataFrame, bits: int, cell_variants: int) -> DataFrame:
    """For each crowded group the bits that divide it best: the most balanced among its own members, as
    many as its load asks for, and only such as at least an eighth of the members differ in."""
    own = groups.join(crowded, GROUP)
    ones = F.array(*[F.struct(F.sum(F.shiftrightunsigned("fp", p).bitwiseAND(1)).alias("ones"), F.lit(p).alias("p")) for p in range(64 - bits)])
    held = own.groupBy(*GROUP).agg(F.first("load").alias("load"), F.count(F.lit(1)).alias("n"), ones.alias("bits"))
    balanced = F.transform("bits", lambda x: F.struct(F.least(x["ones"], F.col("n") - x["ones"]).alias("b"), x["p"].alias("p")))
    one_bit = F.array(*[F.lit(1 << p if p < 63 else -(1 << 63)) for p in range(64)])
    open_ = F.filter(balanced, lambda x: (8 * x["b"] >= F.col("n")) & (F.col("mask").bitwiseAND(F.element_at(one_bit, x["p"] + 1)) == 0))
    wanted = F.ceil(F.log2(F.col("load") / cell_variants)).cast("int")
    chosen = F.slice(F.sort_array(open_, asc=False), 1, wanted)
    add = F.aggregate(chosen, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.element_at(one_bit, x["p"] + 1)))
    return held.select(*GROUP, add.alias("add")).where("add <> 0")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, cell_variants: int = CELL_VARIANTS) -> DataFrame:
    """Links ``a, b`` that connect distinct fingerprints (column ``fp``) exactly as all pairs
    within ``max_bits`` do.

    A group holds the variants of one cell. Groups that would lay out more than four times
    ``cell_variants`` are divided by further bits, chosen by their own members, and counted again until none of them
    can be divided; nothing of this is gathered on the driver."""
    radius = (max_bits + 1) // 2
    n = distinct.count()
    bits = min(24, max(0, int(np.ceil(np.log2(max(1, n * ball(64, radius) / cell_variants))))))
    lead = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    top = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(u).alias("u")) for m, u in flips(list(range(bits)), radius)])
    none = F.lit(0).cast("long")
    groups = distinct.select("fp", F.explode(top).alias("t")).select(
        lead.bitwiseXOR(F.col("t.m")).alias("cell"), none.alias("mask"), none.alias("sub"), F.col("t.u").alias("used"), "fp")
    free = F.lit(64 - bits) - F.bit_count("mask")
    ways = [sum((reduce(lambda a, j: a * (free - j) / (j + 1), range(r), F.lit(1.0)) for r in range(left + 1)), F.lit(0.0))
            for left in range(radius + 1)]
    weight = reduce(lambda w, left: w.when(F.col("used") == radius - left, ways[left]), range(1, radius + 1),
                    F.when(F.col("used") == radius, ways[0]))
    parts = []
    while True:
        crowded = land(groups.groupBy(*GROUP).agg(F.sum(weight).alias("load")).where(F.col("load") > 4 * cell_variants), "simhash-crowded")
        adds = None if crowded.isEmpty() else land(_bits_to_add(groups, crowded, bits, cell_variants), "simhash-bits")
        if adds is None or adds.isEmpty():
            parts.append(groups)
            break
        parts.append(groups.join(adds, GROUP, "left_anti"))
        groups = land(groups.join(adds, GROUP).mapInArrow(_splitter(radius), "cell long, mask long, sub long, used int, fp long"), "simhash-parts")
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy(*GROUP).applyInArrow(_linker(bits, max_bits), "a long, b long")


def _rooted(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """``doc_id, fp, root, component_id`` for every document."""
    prints = land(fingerprints(docs, shingle), "simhash")
    # Exact copies become one row here, with the smallest doc_id of each fingerprint.
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    # Order fingerprints as unsigned numbers nowhere: any fixed order serves for the labels.
    roots = components(links(distinct, max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    # Written first, so that the join below shuffles both sides and can split a large component.
    least = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of_print = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every document: its fingerprint and the smallest doc_id
    reachable over fingerprints at most ``max_bits`` apart."""
    return _rooted(docs, shingle, max_bits).drop("root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each near-duplicate component (the smallest doc_id), with its own columns.
    Of a component's rows that share that doc_id, the one with the least text hash stays; rows of
    one doc_id in different components are different documents."""
    found = land(_rooted(docs, shingle, max_bits), "simhash-rooted")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    repeated = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        ids = keep.select("doc_id")
        return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    once = keep.join(repeated, keep["doc_id"].eqNullSafe(repeated["doc_id"]), "left_anti").select("doc_id")
    out = docs.join(once, docs["doc_id"].eqNullSafe(once["doc_id"]), "left_semi")
    # Rows of repeated doc_ids are told apart by their fingerprints.
    some = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi")
    rows = nest(some).select("row__", F.col("row__.text").cast("string").alias("text"))
    kind = StructType([StructField("doc_id", rows.schema["row__"].dataType), StructField("fp", LongType())])
    rows = rows.mapInArrow(giving_back(_fingerprinter(shingle)), kind).withColumnRenamed("doc_id", "row__")
    keys = keep.select("doc_id", "fp", "root").distinct()
    rows = rows.join(keys, (rows["fp"] == keys["fp"]) & F.col("row__.doc_id").eqNullSafe(keys["doc_id"]))
    plain = [F.col(f"row__.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = [F.sha2(F.col("row__.text").cast("string"), 256), F.xxhash64(*plain)]
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("k = 1")
    return out.unionByName(unnest(first.select("row__")))
