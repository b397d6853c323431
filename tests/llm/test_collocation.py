"""Collocations: the index against plain counting, whole results against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import collocation
from timberline.llm.collocation import FMIndex
from timberline.llm.words import mix

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def counted(docs, max_words):
    f, n = Counter(), Counter()
    for text, lang in docs:
        for piece in PIECE.split(lower(text)):
            w = WORD.findall(piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    return f, n


def brute(docs, min_count, max_words=5, top=2000, inside=100):
    f, n = counted(docs, max_words)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    longest = {}
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    key = lang, p[i:j]
                    longest[key] = max(longest.get(key, 0), a)
    out = {}
    for (lang, p), a in cand.items():
        if 100 * longest.get((lang, p), 0) >= inside * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                    for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", i) for i, (t, lang) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase string, n long")


def result(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("depth", [2, 5])
def test_index_enumerates_all_phrases(depth):
    rng = np.random.default_rng(5)
    seq = np.concatenate([np.append(rng.integers(1, 5, rng.integers(0, 9)), 0) for _ in range(300)])
    keys = mix(np.arange(1, 5, dtype=np.uint64))
    fm = FMIndex(FMIndex.column(seq, depth), keys)
    want = Counter()
    for i in range(len(seq)):
        for k in range(2, depth + 1):
            if i + k <= len(seq) and (seq[i : i + k] > 0).all():
                want[tuple(seq[i : i + k].tolist())] += 1
    got, seen = {}, set()
    for k, lo, n, hashes in fm.levels(lambda k, h: None, depth):
        words = np.stack(fm.spell(lo, k), axis=1).tolist()
        got.update({tuple(w): c for w, c in zip(words, n.tolist(), strict=True)})
        seen.update(hashes.tolist())
    assert got == dict(want) and len(seen) == len(got)


def test_only_frequent_phrases_are_extended():
    seq = np.array([1, 2, 3, 0, 1, 2, 3, 0, 2, 3, 1, 0])
    fm = FMIndex(FMIndex.column(seq, 3), mix(np.arange(1, 4, dtype=np.uint64)))
    two = next(fm.levels(lambda k, h: None, 3))
    spelt = [tuple(x) for x in np.stack(fm.spell(two[1], 2), axis=1).tolist()]
    frequent = {2: two[3][[s in ((1, 2), (2, 3)) for s in spelt]]}
    k, lo, n, _ = list(fm.levels(lambda k, h: np.isin(h, frequent[k]), 3))[1]
    assert np.stack(fm.spell(lo, k), axis=1).tolist() == [[1, 2, 3]] and n.tolist() == [2]


@pytest.mark.parametrize("shape", [{}, {"shard_tokens": 300, "bucket_keys": 50}])
def test_matches_brute_force(spark, shape):
    rng = random.Random(11)
    vocab = ["aa", "Bb", "cc", "dd", "é", "日本", "x'y", "\x1c", "\x00"]
    rows = [("New York city hall. of the", "en")] * 30 + [("NEW york\tCity  hall,of the!", None), (None, "en"), ("", "en"), (" .\t;\n", "de")]
    for i in range(250):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", " ", "\t", ". ", ",", "\r\n", "\x0b"]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "fr", "und", None])))
    want = brute(rows, 5)
    assert len(want) > 60
    assert result(collocation.collocations(table(spark, rows).repartition(3), min_count=5, **shape)) == want


@pytest.mark.parametrize("min_count", [9, 25])
def test_lengths_that_are_sent_together(spark, min_count):
    """Some phrases of four words are frequent and some are not, and both have longer ones."""
    rng = random.Random(min_count)
    rows = [(" ".join(rng.choice("aabc") for _ in range(rng.randrange(3, 30))), "en") for _ in range(150)]
    want = brute(rows, min_count)
    assert {len(r[2].split()) for r in want} >= {4, 5}
    assert result(collocation.collocations(table(spark, rows), min_count=min_count, shard_tokens=600, bucket_keys=100)) == want


def test_other_parameters_and_extensions(spark):
    rows = [("a b c d e f", "en")] * 7 + [("b c d", "en")] * 5 + [("c d", "en")] * 2
    found = collocation.collocations(table(spark, rows), min_count=3, max_words=4, top=3, inside_percent=60)
    assert result(found) == brute(rows, 3, 4, 3, 60)
    counts, _ = collocation.phrases(table(spark, rows), 3, 4)
    ext = {r.phrase: (r.left, r.right) for r in collocation.extensions(counts).collect()}
    assert ext["b c d"] == (7, 7) and ext["c d"] == (12, 7)
    assert result(collocation.collocations(table(spark, rows), min_count=7, max_words=2)) == brute(rows, 7, 2)


def test_awkward_rows(spark, odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert result(collocation.collocations(odd, min_count=4)) == brute(rows, 4)
    assert collocation.collocations(empty).count() == 0
    assert collocation.collocations(odd, min_count=10**6).count() == 0


def test_long_text_is_cut_between_pieces(spark):
    text = ", ".join(f"w{i % 7} v{i % 5} u{i % 3}" for i in range(400_000))  # 5 MB in one text
    rows = [(text, "en"), ("x" * 5_000_000, "en")]
    got = result(collocation.collocations(table(spark, rows).coalesce(1), shard_tokens=1 << 18))
    assert got == brute(rows, 100)


def test_scores_pass_64_bits(spark):
    row = spark.range(1).select(F.expr("(cast(99999999999 as decimal(18,0)) * cast(99999999999999 as decimal(18,0))) a"))
    exact = row.select(F.expr("cast(a as decimal(34,0)) * cast(1000 as decimal(4,0)) div (cast(99999999999 as decimal(18,0)) * cast(7 as decimal(18,0)))"))
    assert exact.first()[0] == 1000 * 99999999999 * 99999999999999 // (99999999999 * 7)
