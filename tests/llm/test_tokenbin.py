import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, models

from timberline.llm import tokenbin
from timberline.llm.queries import QUERIES, TOKENIZER
from timberline.llm.words import text_buffers

SF = "/root/testdata/sf0.001"


def _want(rows):
    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_direct_encoding(spark, sample):
    got = QUERIES["op9_token_output"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(_want(sample))


def test_odd_rows_round_trip(spark, odd, empty):
    path = tokenbin.new_path(spark)
    tokenbin.write(odd, path, public_tokenizers.path(TOKENIZER), files=3)
    assert sorted(map(tuple, tokenbin.digests(spark, path).collect())) == sorted(_want([(r.doc_id, r.text) for r in odd.collect()]))
    path = tokenbin.new_path(spark)
    tokenbin.write(empty, path, public_tokenizers.path(TOKENIZER))
    assert tokenbin.digests(spark, path).count() == 0


def test_words_with_other_rules():
    texts = ["It's <|endoftext|> don't a<b «ñ» x y Σς é \x00\x1f 12ab34 it's 'll's ''", "", "NAÏVE é ﬁ ½ 漢字   x y", "A.B,c!! (d)"]
    enc = tokenbin.WordEncoder(public_tokenizers.path(TOKENIZER))
    from timberline.llm.words import text_buffers
    import pyarrow as pa
    ids, n = tokenbin.encode_texts(enc, *text_buffers(pa.array(texts)), 2)
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_file_layout_and_selective_reads(spark, sample, tmp_path):
    df = spark.createDataFrame(sample, "doc_id long, text string")
    path = tokenbin.new_path(spark)
    tokenbin.write(df, path, public_tokenizers.path(TOKENIZER), files=2)
    files = spark.read.parquet(path).inputFiles()
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    tokens = next(c for p, c in columns.items() if p.startswith("tokens"))
    assert "RLE_DICTIONARY" in tokens.encodings or "PLAIN_DICTIONARY" in tokens.encodings
    assert tokens.has_offset_index and tokens.has_column_index
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    plan = tokenbin.read(spark, path).select("doc_id", "n_tokens").where("doc_id = 7")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert ",tokens:" not in text and "<tokens:" not in text and "EqualTo(doc_id,7)" in text


def _encoded(enc, texts):
    ids, n = tokenbin.encode_texts(enc, *text_buffers(pa.array(texts)), 2)
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_new_words_take_no_python_call_each():
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdefghijklmnop", k=8)) + rng.choice(["", ",", "7", ")!"]) for _ in range(20_000)}
    column = pa.array([" ".join(sorted(words)).title()])
    enc, calls = tokenbin.WordEncoder(public_tokenizers.path(TOKENIZER)), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        tokenbin.encode_texts(enc, *text_buffers(column), 2)
    finally:
        sys.setprofile(None)
    assert calls < len(words) / 10


@pytest.mark.parametrize("limit", [0, 40, 10**6])
def test_random_words_with_small_memories(monkeypatch, limit):
    monkeypatch.setattr(tokenbin, "CACHE_WORDS", limit)
    monkeypatch.setattr(tokenbin, "CACHE_PIECES", limit)
    enc, rng = tokenbin.WordEncoder(public_tokenizers.path(TOKENIZER)), random.Random(11)
    odd = "aZé Þß×÷ÿ09-_<'\x7f\x85\u0301漢İΣ\n½À"
    for alphabet in ("abAB1,. ", "àÀéÉøØ ßþÞ.9", odd, "×÷ x", "<|endotx> "):
        for _ in range(3):
            _encoded(enc, ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(20)])


def test_every_byte_pair_of_latin_1():
    enc = tokenbin.WordEncoder(public_tokenizers.path(TOKENIZER))
    chars = [chr(c) for c in range(256)]
    _encoded(enc, [" ".join(a + b + "q" for b in chars) for a in chars])


def test_model_without_end_of_word_suffix(tmp_path):
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    letters = {c: i for i, c in enumerate([chr(c) for c in range(97, 123)] + ["ab"])}
    whole.model = models.BPE(letters, [("a", "b")])
    whole.save(str(tmp_path / "plain.json"))
    _encoded(tokenbin.WordEncoder(str(tmp_path / "plain.json")), ["Abc cab ab", "", "b1 a'b"])
