"""The pipeline against DuckDB and plain Python, stage by stage, on the smallest tables."""

import sys
import zlib

import brute
import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import __spark_entry__ as E
from timberline.llm import oracle, quality
from timberline.llm.common import documents

SF = "/root/testdata/sf0.001"


def _sql(tmp_path, rows, sql):
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return {x["doc_id"]: x for x in (dict(zip(names, row, strict=True)) for row in r.fetchall())}


def test_run_matches_stages_by_other_means(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    kept = _sql(tmp_path, docs, oracle.QUALITY)
    docs = [d for d in docs if kept[d["doc_id"]]["kept"]]
    prints = [brute.fingerprint(d["text"]) for d in docs]
    least = brute.groups(prints, [d["doc_id"] for d in docs], 4)
    docs = [d for d, m in zip(docs, least, strict=True) if d["doc_id"] == m]
    hit = _sql(tmp_path, docs, oracle.DECONTAMINATION)
    docs = [d for d in docs if not hit[d["doc_id"]]["contaminated"]]
    mixed = _sql(tmp_path, docs, oracle.MIXING)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        m = mixed[d["doc_id"]]
        for _ in range(m["taken"] // m["size"] if m["size"] else 0):
            ids = tokenizer.encode(d["text"], add_special_tokens=False).ids + [2]
            want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
    got = E.queries()["pipeline"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert len(want) > 100


def test_stages_keep_the_columns_of_documents(spark, odd, empty):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    columns = documents(spark, SF).columns
    for docs in (odd.withColumn("n_chars", odd.n_words), empty.withColumn("n_chars", empty.n_words)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and set(columns) <= set(out.columns)
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_policies_and_ablation(spark):
    book = quality.ledger(documents(spark, SF)).cache()
    full = quality.POLICIES[quality.DEFAULT_POLICY]
    judged = quality.apply_policy(book, full).collect()
    alone = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality.ablation(book, full).collect()}
    names = list(quality.rules())
    for rule in full.rules:
        bit = 1 << names.index(rule)
        assert alone[rule] == (sum(1 for r in judged if r.fail_bits & bit), sum(1 for r in judged if r.fail_bits == bit))
    base = {r.row__.doc_id for r in quality.apply_policy(book, quality.POLICIES["base-1"]).where("kept").collect()}
    assert {r.row__.doc_id for r in judged if r.kept} <= base


def test_entry_without_the_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("timberline.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "timberline.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    keys = E.queries()
    assert "pipeline" not in keys and not any(k.startswith("op") for k in keys) and len(keys) > 50
    assert not any(k.startswith("op") for k in E.oracle_sql())


def test_pipeline_keeps_unsegmented_scripts(spark):
    """Clauses of scripts without blanks are no long words; long runs of other scripts are."""
    clause = {"zh": "我们在这个城市里住了很多年并且每天早上都去公园散步和朋友们聊天喝茶", "ja": "わたしたちはこのまちにながくすんでいてまいあさこうえんをさんぽします",
              "th": "เราอาศัยอยู่ในเมืองนี้มาหลายปีและไปเดินเล่นในสวนสาธารณะทุกเช้า", "my": "ကျွန်ုပ်တို့သည်ဤမြို့တွင်နှစ်ပေါင်းများစွာနေထိုင်ခဲ့သည်",
              "ext": "\U00020000" * 30, "en": "abcdefghijklmnopqrstuvwxyzabcdefgh", "ko": "가나다라마바사아자차카타파하" * 3}
    texts = {k: " ".join(f"{v}{chr(97 + i)}" for i in range(12)) for k, v in clause.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()} == {"zh", "ja", "th", "my", "ext"}
    old = quality.apply_policy(quality.ledger(docs), quality.POLICIES["full-1"])
    assert old.where("kept").count() == 0
