"""Vector index over log messages: build, search, expansion and retrieval
context (J1, J2, V1–V5, K6, K10, T5, X11, X12, P2).

The vector table is a DataFrame ``(log_id, embedding ARRAY<FLOAT>, ts,
hostname, source, unit, severity, document)``. Search is exact squared-L2 (the
distance the reference's store uses by default): metadata filters run first,
the query vector is a literal inside the projection, and the top-k is a
TakeOrderedAndProject, so each task keeps only its own k best rows.
"""

from __future__ import annotations

import sys

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import fill, py_str, py_ts_str, search_text
from timberline.operators.window import in_window, since_start, ts_lit
from timberline.params import ChatParams, IndexParams, SearchParams
from timberline.schema import DEFAULT_EMBED_DIM
from timberline.session import materialize

META_COLUMNS = ["ts", "hostname", "source", "unit", "severity"]

# Python UDFs defined here are shipped to executors by value, so the workers
# need numpy/pandas but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: retrieval context -------------------------------------------
CONTEXT_HEADER = "Relevant log entries:"
CONTEXT_LINE = "{n}. [{ts}] {unit} ({severity}): {message}"
NO_CONTEXT = "No relevant logs found."
# -----------------------------------------------------------------------------

MAX_HITS = 10_000  # search hits that are broadcast
HASHING_DIM = 64  # length of the default model's vectors


# --- embedding models (P2) ---------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hashing_embedding(text: Column, dim: int = HASHING_DIM) -> Column:
    """The default model, in built-in functions: each lower-cased blank-separated token adds
    +1 or -1 to one of ``dim`` buckets (MD5 digits 1-8: bucket, digit 9: odd = -1); the sums
    are L2-normalised. NULL text gives NULL, text without tokens zeros."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")

    def code(digest: Column) -> Column:  # bucket number from 1, with the sign
        bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim + 1
        odd = F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 1
        return F.when(odd, -bucket).otherwise(bucket).cast("int")

    def sums(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.aggregate(
            codes, F.lit(0), lambda n, c: F.when(c == i, n + 1).when(c == -i, n - 1).otherwise(n)))

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda n, c: n + c * c))
        return _let(norm, lambda length: F.transform(counts, lambda c: F.when(
            length > 0, c / length).otherwise(0.0).cast("float")))

    codes = F.transform(tokens, lambda t: _let(F.md5(t.cast("binary")), code))
    return F.when(text.isNotNull(), _let(_let(codes, sums), scaled))


def with_embedding(df: DataFrame, text_col: str, out_col: str = "embedding", model=None) -> DataFrame:
    """V2: add ``out_col``, the embedding of ``text_col``: by ``hashing_embedding``, or by a
    ``model`` of the caller (``model_embedding``). NULL text or a model failure gives NULL."""
    text = F.col(text_col)
    return df.withColumn(out_col, hashing_embedding(text) if model is None else model_embedding(text, model))


def model_embedding(text: Column, model) -> Column:
    """V2/P2 for a pluggable model: any object with ``embed(list[str]) ->
    np.ndarray`` (rows of NaN = failure), called on whole Arrow batches by an
    iterator pandas UDF. A text the model cannot embed gives NULL."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vecs = np.asarray(model.embed(texts.tolist()), dtype=np.float32)
            yield pd.Series([None if np.isnan(v).any() else v.tolist() for v in vecs])

    return _embed(text)


# --- index build and maintenance -------------------------------------------


def vector_rows(vectors: DataFrame, logs: DataFrame, dim: int = DEFAULT_EMBED_DIM) -> DataFrame:
    """K6: vector table rows from ``(log_id, embedding)`` and the log rows:
    metadata NULLs become ``''``, a missing vector becomes ``dim`` zeros, the
    document is the message (the search text, X11, is what was embedded). Equi-join on the log id (shuffle, or
    broadcast when AQE sees a small side)."""
    meta = logs.select(F.col("id").alias("log_id"), *META_COLUMNS, "message")
    df = vectors.join(meta, "log_id", "inner")
    return df.select(
        "log_id",
        F.coalesce(F.col("embedding"), F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"),
        F.col("ts"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in META_COLUMNS[1:]],
        F.coalesce(F.col("message"), F.lit("")).alias("document"))


def index_candidates(logs: DataFrame, ledger: DataFrame, as_of, p: IndexParams) -> DataFrame:
    """Logs in the window that are not in the ledger, newest first, at most
    ``p.limit`` (None = all). ``left_anti`` on the ledger key (never NULL)."""
    window = in_window(logs, as_of, p.since)
    pending = window.join(ledger.select(F.col("log_id").alias("id")), "id", "left_anti")
    pending = pending.select("id", *META_COLUMNS, "message",
                             search_text(F.col("hostname"), F.col("unit"), F.col("message")).alias("search_text"))
    if p.limit is not None:
        pending = pending.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(p.limit)
    return pending


def index_logs(logs: DataFrame, ledger: DataFrame, as_of, p: IndexParams, model=None) -> tuple[DataFrame, DataFrame]:
    """V1: embed the pending rows; rows the model fails on are left out.
    Returns (new vector rows, new ledger rows ``(log_id, indexed_at)``)."""
    cand = index_candidates(logs, ledger, as_of, p)
    # The default model fails on NULL text alone: asking the text spares a second evaluation.
    done = F.col("search_text" if model is None else "embedding").isNotNull()
    emb = with_embedding(cand, "search_text", "embedding", model).filter(done)
    vec = emb.select(F.col("id").alias("log_id"), "embedding", "ts",
                     *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in META_COLUMNS[1:]],
                     F.coalesce(F.col("message"), F.lit("")).alias("document"))
    led = emb.select(F.col("id").alias("log_id"), ts_lit(as_of).alias("indexed_at"))
    return vec, led


def retention(ledger: DataFrame, vectors: DataFrame, as_of, days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop ledger rows indexed before ``as_of - days`` and their vectors.
    Returns (kept ledger, kept vectors, one-row ``deleted, kept`` counts)."""
    cutoff = ts_lit(since_start(as_of, days * 86400))
    kept = ledger.filter(F.col("indexed_at") >= cutoff)
    old = ledger.filter(~(F.col("indexed_at") >= cutoff) | F.col("indexed_at").isNull())
    kept_vectors = vectors.join(old.select("log_id"), "log_id", "left_anti")
    counts = ledger.agg(F.count_if(~(F.col("indexed_at") >= cutoff) | F.col("indexed_at").isNull()).alias("deleted"),
                        F.count_if(F.col("indexed_at") >= cutoff).alias("kept"))
    return kept, kept_vectors, counts


# --- search -----------------------------------------------------------------


def squared_l2(embedding: Column, query: list[float]) -> Column:
    """Exact squared Euclidean distance in DOUBLE to a literal query vector."""
    q = F.array(*[F.lit(float(x)).cast("double") for x in query])
    diffs = F.zip_with(embedding, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def search(vec_table: DataFrame, query: list[float], p: SearchParams, as_of) -> DataFrame:
    """V3/T5: the ``p.n_results`` nearest vectors after the metadata filters
    (since, source, unit, severity). Output ``log_id, distance, similarity,
    rank`` (similarity = 1 − distance, X12; distances rounded to 6 places)."""
    df = vec_table
    if p.since is not None:
        df = df.filter(F.col("ts") >= ts_lit(since_start(as_of, p.since)))
    for name in ("source", "unit", "severity"):
        v = getattr(p, name)
        if v is not None:
            df = df.filter(F.col(name) == v)
    # Vectors of another length (a zero fill of another model) have no distance and are no hits.
    df = df.filter(F.size("embedding") == len(query))
    top = (df.select("log_id", squared_l2(F.col("embedding"), query).alias("_d"))
           .filter(F.col("_d").isNotNull() & ~F.isnan("_d"))
           .orderBy(F.col("_d"), F.col("log_id")).limit(p.n_results))
    # ``top`` holds at most n_results (<= 100) rows: numbering them is local work.
    rank = F.row_number().over(Window.orderBy(F.col("_d"), F.col("log_id")))
    return top.select("log_id", F.round("_d", 6).alias("distance"), F.round(1 - F.col("_d"), 6).alias("similarity"),
                      rank.alias("rank"))


def embed_query(spark: SparkSession, text: str, model=None) -> list[float] | None:
    """The vector of one query text by the model that embeds the log rows; None on failure."""
    row = with_embedding(spark.createDataFrame([(text,)], "t string"), "t", "e", model).first()
    return None if row["e"] is None else list(row["e"])


def search_by_text(vec_table: DataFrame, text: str, p: SearchParams, as_of, model=None) -> DataFrame:
    """V3 from a text: embed it with the model of the index, then the nearest rows of the
    index. A text the model cannot embed is an error."""
    vector = embed_query(vec_table.sparkSession, text, model)
    if vector is None:
        raise ValueError("the query text could not be embedded")
    return search(vec_table, vector, p, as_of)


def expand_hits(hits: DataFrame, logs: DataFrame) -> DataFrame:
    """Full log rows of the hits, newest first, each with its own score
    (paired by id, D3). ``hits`` are counted before they are broadcast: up to MAX_HITS rows (a search
    gives ``n_results`` <= 100) the log table is only scanned; more are joined as Spark sees fit."""
    hits = materialize(hits.withColumnRenamed("log_id", "id"))
    rows = logs.join(F.broadcast(hits) if hits.count() <= MAX_HITS else hits, "id", "inner")
    return rows.select("id", "ts", "hostname", "source", "unit", "severity", "message", "similarity", "rank") \
               .orderBy(F.col("ts").desc(), F.col("id"))


def rag_context(expanded: DataFrame) -> DataFrame:
    """V5: one row ``context`` with numbered lines ``i. [ts] unit (severity): message``
    in expansion order under a header, or ``No relevant logs found.``"""
    item = F.struct(F.lit(0) - F.unix_micros(F.col("ts").cast("timestamp")), F.col("id"),
                    F.coalesce(py_ts_str(F.col("ts")), F.lit("")).alias("ts"), py_str(F.col("unit")).alias("unit"),
                    py_str(F.col("severity")).alias("severity"), py_str(F.col("message")).alias("message"))
    agg = expanded.agg(F.sort_array(F.collect_list(item)).alias("_items"))
    lines = F.transform(F.col("_items"), lambda x, i: fill(
        CONTEXT_LINE, n=i + 1, ts=x["ts"], unit=x["unit"], severity=x["severity"], message=x["message"]))
    return agg.select(
        F.when(F.size("_items") == 0, F.lit(NO_CONTEXT))
         .otherwise(F.concat(F.lit(CONTEXT_HEADER + "\n"), F.array_join(lines, "\n"))).alias("context"),
        F.size("_items").alias("n_logs"))


def chat_context(vec_table: DataFrame, logs: DataFrame, question: str, as_of, p: ChatParams, model=None) -> DataFrame:
    """CHAT without the model's answer: the context of the ``context_size`` nearest log rows of the
    window, within the contract's bounds."""
    hits = search_by_text(vec_table, question, SearchParams(n_results=p.context_size, since=p.since), as_of, model)
    return rag_context(expand_hits(hits, logs))


def rag_prompt(context: DataFrame, question: str, template: str) -> DataFrame:
    """The text handed to a language model (the model call itself is outside Spark): the
    caller's ``template`` with ``{context}`` and, after it, ``{question}`` filled in."""
    head, rest = template.split("{context}")
    mid, tail = rest.split("{question}")
    return context.select(F.concat(F.lit(head), F.col("context"), F.lit(mid), F.lit(question), F.lit(tail))
                          .alias("prompt"))
