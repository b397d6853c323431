import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import simhash
from timberline.llm.components import components
from timberline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_query_matches_brute_force(spark, sample):
    prints = [brute.fingerprint(t) for _, t in sample]
    want = {d: (f"{p:016x}", c) for (d, _), p, c in
            zip(sample, prints, brute.groups(prints, [d for d, _ in sample], 4), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4])
@pytest.mark.parametrize("cell_variants", [10**9, 3000])
def test_links_connect_like_all_pairs(spark, max_bits, cell_variants):
    """A dense cluster, chains of flips and strangers; cells from one to many, crowded ones cut."""
    rng = random.Random(max_bits)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(60)} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    chain = rng.getrandbits(64)
    for _ in range(40):
        for _ in range(rng.randrange(1, 6)):
            chain ^= 1 << rng.randrange(64)
        prints.add(chain)
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(table, max_bits, cell_variants)).collect()}
    want = brute.groups(prints, signed, max_bits)
    assert [roots.get(p, p) for p in signed] == want


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[8].component_id == 7 and by[4].component_id == 4
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 7} <= set(ids) and 8 not in ids and 2 not in ids
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_null_ids_and_words_that_hash_alike(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "A b  c\nd e"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(df).where(F.col("fp") != 0).collect())
    assert got == [(False, 5), (True, 5)]


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (500, 600)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 500: 400, 600: 400}
    assert components(links.limit(0)).count() == 0


def test_keep_one_keeps_a_row_of_each_group_under_repeated_ids(spark):
    """Unrelated texts of one doc_id are two groups; a copy of another doc_id's text goes."""
    a, b, c = (" ".join(f"{w}{i * i}" for i in range(60)) for w in ("left", "up", "mid"))
    rows = [(5, a, 1), (5, b, 2), (6, b, 3), (3, c, 4), (7, c, 5), (7, "other " + a[::-1], 6), (None, " ".join(f"no{i ** 3}" for i in range(60)), 7), (9, b.upper(), 8)]
    for order in (rows, rows[::-1]):
        got = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, n long")).collect()
        assert sorted(r.n for r in got) == [1, 2, 4, 6, 7]
    same = spark.createDataFrame([(1, a, 1), (1, a, 2), (2, a, 3)], "doc_id long, text string, n long")
    got = {tuple(simhash.keep_one(same.repartition(k)).collect()) for k in (1, 3)}
    assert len(got) == 1 and [len(g) for g in got] == [1]


@pytest.mark.parametrize("limit", [10**9, 5000, 300])
def test_a_cell_done_in_parts_links_alike(limit):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << p for p in rng.sample(range(40), rng.randrange(1, 7))) for _ in range(150)}
    fp = np.array(sorted(prints), dtype=np.uint64)
    a, b = simhash.link_cell(fp, np.zeros(len(fp), dtype=np.int32), tuple(range(64)), 4, limit)
    index = {int(x): i for i, x in enumerate(fp)}
    label = simhash._least(len(fp), np.array([index[int(x)] for x in a]), np.array([index[int(x)] for x in b]))
    assert fp[label].tolist() == brute.groups([int(x) for x in fp], [int(x) for x in fp], 4)


def test_fingerprints_of_one_template_are_divided(spark):
    """Fingerprints that share their leading 40 bits crowd a few cells; the parts hold few variants each."""
    rng = np.random.default_rng(3)
    low = np.unique(rng.integers(0, 1 << 24, 6000, dtype=np.uint64))
    prints = (np.uint64(0xABCDE12345) << np.uint64(24)) | low
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(table, 4, 20_000)).collect()}
    near = {}
    for i in range(0, len(prints), 500):
        d = np.bitwise_count(prints[i : i + 500, None] ^ prints[None, :])
        for x, y in zip(*np.nonzero(d <= 4), strict=True):
            near.setdefault(i + int(x), []).append(int(y))
    a = np.array([x for x, ys in near.items() for _ in ys])
    b = np.array([y for ys in near.values() for y in ys])
    label = simhash._least(len(prints), a, b)
    signed = prints.view(np.int64)
    groups = {}
    for i, g in enumerate(label.tolist()):
        groups.setdefault(g, set()).add(roots.get(int(signed[i]), int(signed[i])))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
