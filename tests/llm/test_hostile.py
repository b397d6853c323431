"""Texts made to be slow: every one is done in seconds, with the results of plain rules."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from timberline.llm import decontam, langid, secret_scan, toxicity
from timberline.llm.words import text_buffers


@pytest.fixture(autouse=True)
def soon():
    start = time.monotonic()
    yield
    assert time.monotonic() - start < 60


def test_backslashes_in_an_unclosed_quote():
    for n in (10, 10_000, 300_000):
        text = b'password="' + b"\\" * n + b"x"
        assert list(secret_scan._named_values(text))
    assert [v[3] for v in secret_scan._named_values(b'token="a\\"b" x')] == ["token"]
    a, b = next(iter(secret_scan._named_values(b'secret="a\\"b c" x')))[1:3]
    assert b'secret="a\\"b c" x'[a:b] == b'a\\"b c'
    a, b = next(iter(secret_scan._named_values(b'secret="C:\\dir\\" x')))[1:3]
    assert b'secret="C:\\dir\\" x'[a:b] == b"C:\\dir\\"


def test_a_million_marks_at_the_edges():
    assert toxicity.core("a" + "!" * 1_000_000 + "a") == "a" + "!" * 1_000_000 + "a"
    assert toxicity.core("!" * 1_000_000 + "Ab." + "?" * 1_000_000) == "ab"
    assert toxicity.core("!" * 1_000_000) == "" and toxicity.core("") == ""


def spans(items, text, window=13):
    tests = decontam.TestSuffixes(items, window)
    counts, rows = decontam.match_texts(tests, *text_buffers(pa.array([text])))
    return counts.tolist(), rows


def test_equal_words_in_item_and_text():
    counts, rows = spans([("1", "a " * 20_000), ("2", "b " * 30), ("3", "a " * 40)], "a " * 20_000)
    assert counts == [20_000] and set(rows[:, 1].tolist()) == {0, 2}
    assert rows[rows[:, 1] == 0].tolist() == [[0, 0, 0, 0, 20_000]]
    covered = np.zeros(20_000, dtype=bool)
    for _, item, _, at, n in rows.tolist():
        if item == 2:
            covered[at : at + n] = True
    assert covered.all()


def test_repeated_words_are_covered_like_by_plain_rules():
    rng = random.Random(4)
    for _ in range(40):
        items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))) for i in range(4)]
        text = " ".join(rng.choice("aab") for _ in range(rng.randrange(40)))
        words, hit, found = text.split(), set(), set()
        for i, (_, item) in enumerate(items):
            w = item.split()
            k = min(4, len(w))
            for s in range(len(w) - k + 1):
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == w[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(i)
        _, rows = spans(items, text, 4)
        assert {p for _, _, _, at, n in rows.tolist() for p in range(at, at + n)} == hit
        assert set(rows[:, 1].tolist()) == found
        for _, i, item_at, at, n in rows.tolist():
            assert items[i][1].split()[item_at : item_at + n] == words[at : at + n]


def test_many_places_are_done_some_items_at_a_time(monkeypatch):
    items, text = [(str(i), "a " * (20 + i)) for i in range(12)], "a " * 500 + "b " + "a " * 30
    whole = spans(items, text)[1].tolist()
    monkeypatch.setattr(decontam, "PLACES", 100)
    assert sorted(spans(items, text)[1].tolist()) == sorted(whole)


@pytest.mark.parametrize("text,quoted", [
    ("you’re a worthless X and I’m done", False), ("you're a worthless X and I'm done", False), ("they said “you X now” once", True),
    ('they said "you X now" once', True), ('he left". A real X came "again', False), ("« oh X » said she", True), ("„du X“, rief er", True),
    ("‘what an X’ they wrote", True), ('word " X " word', True), ("no marks X here", False), ("it’s an ‘X’, isn’t it", True)])
def test_quotations(text, quoted):
    assert toxicity.quotation(text, text.index("X")) is quoted


def test_a_language_of_long_texts_is_learned(spark):
    de, en = "der die das und ist nicht ein eine mit auf für".split(), "the and is not a with for on that this".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(de) for _ in range(8000)), "de") for i in range(30)]
    rows += [(100 + i, " ".join(rng.choice(en) for _ in range(20)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F
    taken = langid.sample(docs, F.lit(True)).collect()
    assert {r.lang for r in taken} == {"de", "en"} and max(len(r.text.encode()) for r in taken) <= langid.SAMPLE_BYTES
    assert sorted(langid.fit(docs, F.lit(True)).langs) == ["de", "en"]


def test_toxic_texts_that_are_long_are_learned_from(spark):
    rng = random.Random(6)
    filler = "plain quiet words about the weather of a long day".split()
    rows = [(i, " ".join(rng.choice([*filler, "scoundrel"] if i % 2 else filler) for _ in range(6000))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    from pyspark.sql import functions as F
    model = toxicity.fit(docs, labels, F.lit(True))
    scores = {r.row__.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in range(1, 40, 2)) > 0.7 > max(scores[i] for i in range(0, 40, 2))
