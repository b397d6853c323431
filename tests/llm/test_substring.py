import random

import brute
import pytest

from timberline.llm import substring
from timberline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.kept_digest(df).collect()}


def test_query_matches_brute_force(spark, sample):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, SF).collect()}
    assert got == brute.substring_dedup(sample)


@pytest.mark.parametrize("block_rows", [3, 17, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_small_alphabet(spark, block_rows, seed, monkeypatch):
    """Few different words, so that windows repeat everywhere; blocks of all sizes."""
    monkeypatch.setattr(substring, "SHARD_WORDS", 40)
    rng = random.Random(seed)
    common = [" ".join(rng.choice("ab") for _ in range(n)) for n in (5, 9, 30)]
    docs = []
    for i in range(60):
        parts = [rng.choice([rng.choice("abcdefgh"), rng.choice("ab"), rng.choice(common)]) for _ in range(rng.randrange(30))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    docs += [(100 + i, docs[i % 3][1]) for i in range(10)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _got(substring.dedup(df, window=5, gram=3, block_rows=block_rows)) == brute.substring_dedup(docs, 5)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute.substring_dedup(rows)
    found = substring.kept_digest(substring.dedup(odd, block_rows=2)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == want
    assert all(r.n_removed == 0 for r in found if r.doc_id == 7)
    assert substring.dedup(empty).count() == 0


def test_null_id_is_last(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (3, text), (None, text + " x")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substring.dedup(df).collect()) == [(False, 0), (True, 20), (True, 20)]


def test_matching_statistics():
    rng = random.Random(5)
    passages = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 25))] for _ in range(12)]
    sam = substring.SuffixAutomaton()
    for p in passages:
        sam.add(p)
    text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(300)]
    runs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    want = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(text))]
    assert sam.matching(text) == want
