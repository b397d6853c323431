"""Queries with SQL against DuckDB, on the smallest tables and on rows made to be awkward."""

import math

import duckdb
import pytest

from timberline.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = [tuple(round(r[i], 4) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(norm, key=repr)


def _duck(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    r = con.execute(sql)
    return _rows([d[0] for d in r.description], r.fetchall())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, key):
    df = QUERIES[key](spark, SF)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _duck(SF, ORACLE[key])


@pytest.mark.parametrize("key", sorted(ORACLE))
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_awkward_rows_match_oracle(spark, odd, empty, tmp_path, key, kind):
    import pyarrow as pa
    import pyarrow.parquet as pq
    docs = (odd if kind == "odd" else empty).toArrow()
    keep = [i for i in range(docs.num_rows) if docs["doc_id"][i].as_py() != 7 or i % 2 == 0]
    pq.write_table(docs.take(pa.array(keep, pa.int64())), tmp_path / "documents.parquet")
    items = [(1, "again and AGAIN until the window is long enough to count as thirteen words"), (2, "one"), (2, "One!"),
             (10, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15 w16x16 w17x17 w18x18"), (3, None), (4, " - ")]
    bench = pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]})
    pq.write_table(bench if kind == "odd" else bench.slice(0, 0), tmp_path / "benchmark.parquet")
    df = QUERIES[key](spark, str(tmp_path))
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _duck(str(tmp_path), ORACLE[key])


def test_benchmark_in_several_blocks(spark):
    """A benchmark beyond one broadcast block gives the same result."""
    from timberline.llm import decontam
    from timberline.llm.common import documents, table
    docs, items = documents(spark, SF), table(spark, SF, "benchmark")
    columns = ["row__.doc_id", "n_words", "n_hit", "items", "contaminated"]
    one = decontam.match(docs, items).select(*columns).collect()
    many = decontam.match(docs, items, block_bytes=2500).select(*columns).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and any(r.contaminated for r in one)
