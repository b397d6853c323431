"""Fill-in-the-middle: select over SWAR words against Python's own code points."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.llm import fim

TEXTS = ["", "a", "é", "日本語テキスト", "🙂" * 9, "x" * 7 + "é", "x" * 8, "ab🙂cdéf" * 40, None, "\x00a\x00", "é" * 5000 + "z", ""]


def expected(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("slice_bytes", [1, 50, 1 << 20])
def test_cuts_lie_between_code_points(slice_bytes):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aé日🙂 ") for _ in range(rng.randrange(70))) for _ in range(300)]
    one, two = (np.array([rng.randrange(2**32) for _ in texts]) for _ in range(2))
    n, first, second, at1, at2 = fim.cut_points(pa.array(texts, pa.string()), one, two, slice_bytes)
    for i, t in enumerate(texts):
        t = t or ""
        a, b = sorted((int(one[i]) % (len(t) + 1), int(two[i]) % (len(t) + 1)))
        assert (n[i], first[i], second[i]) == (len(t), a, b)
        assert (at1[i], at2[i]) == (len(t[:a].encode()), len(t[:b].encode()))


def test_sliced_column_and_invalid_bytes():
    column = pa.array(["xx", "é日", "yy"]).slice(1, 2)
    n, first, *_ = fim.cut_points(column, np.array([1, 1]), np.array([1, 1]))
    assert n.tolist() == [2, 2] and first.tolist() == [1, 1]
    # A continuation byte that begins a text belongs to that text alone.
    data, bounds = np.frombuffer(b"a\x80b", dtype=np.uint8), np.array([0, 1, 3])
    assert fim.CodePoints(data, bounds).rank(np.array([1, 3])).tolist() == [1, 3]


def test_forms_and_restored_texts(spark, sample):
    rows = sample[:150] + [(i + 10**6, t) for i, t in enumerate(TEXTS)] + [(None, "some text"), (7, "a <M> b"), (7, "a <M> b"), (8, "a<S"), (9, "<<P")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, output string")
    found = fim.transform(docs).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((repr(d), *map(repr, expected(d, t)), repr(t or "")) for d, t in rows)
    got = sorted((repr(r.row__.doc_id), *map(repr, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), repr(r.restored)) for r in found)
    assert got == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_long_text_and_empty_table(spark, empty):
    docs = spark.createDataFrame([(i, "é日x" * 700_000) for i in range(3)], "doc_id long, text string")
    for r in fim.transform(docs).collect():
        assert tuple(r)[1:] == expected(r.row__.doc_id, r.row__.text)
    assert fim.transform(empty).count() == 0
