"""Source registry, pluggable parsers and multi-source ingest.

A source is a plain configuration object; reading one yields a DataFrame of
parsed log rows tagged with ``source_name``. ``read_all`` builds every enabled
source, isolating failures per source on the driver (a missing path or a bad
config is reported, the other sources still run), and unions the rest.
"""

from __future__ import annotations

import json
import sys

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import json_or_wrap
from timberline.params import IngestParams
from timberline.schema import PARSED
from timberline.operators import ingest
from timberline.operators.cursor_keys import CursorKeys
from timberline.sources import files as files_mod
from timberline.sources import filters, parsers
from timberline.sources.positions import ends, read_between


@dataclass
class LogSource:
    """``type`` is a key of the parser registry (journald, file, container, or a
    registered custom type). ``config`` keys: ``lines`` (a DataFrame with a
    ``value`` column, and ``seq`` where the input has an order) or ``paths``/``patterns``;
    ``by_position`` (files resumed by byte position in ``ingest_all``); ``units``, ``exclude_units``;
    ``year`` (syslog); ``include_patterns``/``exclude_patterns`` (containers)."""
    name: str
    type: str
    enabled: bool = True
    config: dict = field(default_factory=dict)


ParserFn = Callable[[DataFrame, dict], DataFrame]

# Python UDFs defined here are shipped to executors by value, so the workers
# need numpy/pandas but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_PARSERS: dict[str, ParserFn] = {}

# The name of a container in the path of its log file.
CONTAINER_FILE = r"([^/]+?)(?:-json)?\.log$"


def register_parser(source_type: str, fn: ParserFn) -> None:
    """Make ``fn(lines_df, config) -> parsed_df`` the parser of ``source_type``."""
    _PARSERS[source_type] = fn


def parser_for(source_type: str) -> ParserFn:
    if source_type not in _PARSERS:
        raise ValueError(f"Unknown source type: {source_type}")
    return _PARSERS[source_type]


def python_line_parser(fn: Callable[[str], dict | None]) -> ParserFn:
    """P1 slow path: wrap a per-line Python function (line -> dict of parsed
    fields, or None to drop) as a vectorised pandas UDF returning a struct.
    ``raw`` defaults to the line; it is kept when JSON, else wrapped (X6).

    Only for formats the built-in expressions cannot express; it runs on the
    executors in Arrow batches.
    """
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PARSED.fields) + ", _ok boolean"

    @F.pandas_udf(ddl)
    def _parse(lines: pd.Series) -> pd.DataFrame:
        recs = []
        for line in lines:
            d = fn(line) if line is not None else None
            rec = {f.name: None for f in PARSED.fields}
            if d:
                rec.update({k: v for k, v in d.items() if k in rec})
            rec["_ok"] = bool(d)
            recs.append(rec)
        return pd.DataFrame.from_records(recs, columns=[f.name for f in PARSED.fields] + ["_ok"])

    def run(lines: DataFrame, config: dict) -> DataFrame:
        keep = [c for c in lines.columns if c != "value"]
        out = lines.select(_parse(F.col("value")).alias("p"), F.col("value").alias("_line"), *keep) \
                   .filter(F.col("p._ok"))
        out = out.select(*[F.col(f"p.{f.name}").alias(f.name) for f in PARSED.fields], "_line", *keep)
        return out.withColumn("raw", json_or_wrap(F.coalesce(F.col("raw"), F.col("_line")))) \
                  .drop("_line").filter(F.col("ts").isNotNull())

    return run


def _journald(lines: DataFrame, config: dict) -> DataFrame:
    df = parsers.parse_journald(lines, keep=[c for c in lines.columns if c != "value"])
    df = filters.include_units(df, config.get("units"))
    return filters.exclude_units(df, config.get("exclude_units"))


def _file(lines: DataFrame, config: dict) -> DataFrame:
    if "year" not in config:
        raise ValueError("file sources need config['year'] (syslog lines carry no year)")
    return parsers.parse_syslog(lines, int(config["year"]), strict_compat=config.get("strict_compat", False),
                                keep=[c for c in lines.columns if c != "value"])


def _container(lines: DataFrame, config: dict) -> DataFrame:
    if "container" not in lines.columns:
        lines = lines.withColumn("container", F.regexp_extract("file_path", CONTAINER_FILE, 1))
    lines = filters.container_glob_filter(lines, config.get("include_patterns", ["*"]),
                                          config.get("exclude_patterns", []))
    return parsers.parse_container(lines, hostname=config.get("hostname", "localhost"),
                                   keep=[c for c in lines.columns if c not in ("value", "container")])


register_parser("journald", _journald)
register_parser("file", _file)
register_parser("container", _container)


def source_lines(spark: SparkSession, source: LogSource) -> DataFrame:
    cfg = source.config
    if "lines" in cfg:
        return cfg["lines"]
    return files_mod.read_lines(spark, cfg["paths"], cfg.get("patterns", files_mod.DEFAULT_PATTERNS),
                                cfg.get("max_file_size_mb", files_mod.DEFAULT_MAX_FILE_MB),
                                cfg.get("modified_since"))


def read_source(spark: SparkSession, source: LogSource, as_of, since_seconds: int | None = 3600,
                limit: int | None = None, after_cursor: str | None = None) -> DataFrame:
    """Parsed rows of one source, tagged ``source_name``; look-back ``since`` and
    an optional row limit (journald: newest N; other types: first N in input order).

    With ``after_cursor`` (journald) the read resumes after the row that carries it in the
    input's order (``seq``), whatever the look-back and the rows' times say: a row that was
    written later belongs to the next run even if its clock was behind. A cursor that is no
    longer in the input, or an input without ``seq``, is read from its start, and the dedup leaves
    out what is stored: nothing is lost. A limit then takes the first rows in input order; without an order
    it is left to ``ingest_into``, which counts new rows only."""
    parsed = parser_for(source.type)(source_lines(spark, source), source.config)
    ordered = "seq" in parsed.columns
    if after_cursor is None:
        parsed = filters.since_filter(parsed, as_of, since_seconds)
    elif ordered:
        reached = parsed.filter(F.col("cursor") == F.lit(after_cursor)).agg(F.max("seq").alias("at")).first()["at"]
        if reached is not None:
            parsed = parsed.filter(F.col("seq") > F.lit(reached))
    if limit is not None:
        if after_cursor is not None:
            parsed = filters.first_n(parsed, limit, ["seq"]) if ordered else parsed
        elif source.type == "journald":
            parsed = filters.newest(parsed, limit, tie_col="cursor")
        else:
            order = [c for c in ("file_path", "line_pos", "seq") if c in parsed.columns] or ["ts"]
            parsed = filters.first_n(parsed, limit, order)
    return parsed.withColumn("source_name", F.lit(source.name))


def read_all(spark: SparkSession, sources: list[LogSource], as_of, since_seconds: int = 3600,
             limit: int | None = None, state: DataFrame | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Every enabled source (default: the last hour, all its rows). With the cursor
    ``state`` of earlier runs (K2), a journald source resumes after its stored cursor.
    Returns the union and ``{source_name: error}`` for sources that could not be planned.
    Unknown types are errors."""
    frames, errors = [], {}
    names = [s.name for s in sources if s.enabled and s.type == "journald"]
    cursors = {} if state is None else {r["source"]: r["cursor"] for r in state.filter(
        F.col("source").isin(names)).select("source", "cursor").collect()}  # one row for each source asked for
    for src in sources:
        if not src.enabled:
            continue
        try:
            df = read_source(spark, src, as_of, since_seconds, limit, cursors.get(src.name))
            df.schema  # noqa: B018 - forces analysis so a bad path fails here
            frames.append(df)
        except Exception as exc:  # noqa: BLE001 - one source must not stop the others
            errors[src.name] = str(exc).splitlines()[0][:500]
    if not frames:
        return None, errors
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), errors


def _positions(state: DataFrame | None, key: str) -> dict[str, int]:
    row = None if state is None else state.filter(F.col("source") == F.lit(key)).first()
    return json.loads(row["cursor"]) if row is not None else {}


def ingest_all(spark: SparkSession, sources: list[LogSource], table_path: str, state_path: str | None, as_of,
               since_seconds: int | None = 3600, limit: int | None = None,
               keys: CursorKeys | None = None) -> tuple[dict, dict[str, str]]:
    """Ingest every enabled source into one table, one after the other in the
    order given, each resuming after its stored cursor or positions. ``limit`` stores the first
    rows of each source that are new; the next run goes on where this one stopped, so no row is lost.
    A source with ``by_position`` reads only what its files got since the last run; the look-back
    applies to its first run. A source that cannot be planned or
    fails while it is read is reported and adds no row; the others are stored all the same.
    Failures of the table or the state itself are raised. ``keys``: the table's cursor key table.
    Returns ``{source: (parsed_rows, inserted_rows)}`` and ``{source: error}``."""
    counts, errors = {}, {}
    for src in sources:
        if not src.enabled:
            continue
        state = ingest.read_state(spark, state_path) if state_path is not None else None
        positions = None
        try:
            reading, since = src, since_seconds
            if src.config.get("by_position"):
                key = f"{src.name}#positions"
                known = _positions(state, key)
                patterns = src.config.get("patterns", files_mod.DEFAULT_PATTERNS)
                end = {**known, **ends(src.config["paths"], known, patterns)}
                positions, since = (key, known, end), None if known else since_seconds
                config = {k: v for k, v in src.config.items() if k != "by_position"}
                reading = LogSource(src.name, src.type, True, {**config, "lines": read_between(spark, known, end)})
                state = None  # the positions say where to go on
        except Exception as exc:  # noqa: BLE001 - one source must not stop the others
            errors[src.name] = str(exc).splitlines()[0][:500]
            continue
        parsed, failed = read_all(spark, [reading], as_of, since, None, state)
        if parsed is None:
            errors.update(failed)
            continue
        if "seq" not in parsed.columns:
            parsed = parsed.withColumn("seq", F.monotonically_increasing_id())
        try:
            counts.update(ingest.ingest_into(parsed, table_path, state_path, as_of, [src.name], limit=limit,
                                             keys=keys, positions=positions))
        except ingest.UnreadableBatch as exc:
            errors[src.name] = str(exc).splitlines()[0][:500]
    return counts, errors


def ingest_journal(spark: SparkSession, source: LogSource, table_path: str, state_path: str, as_of, p: IngestParams,
                   keys: CursorKeys | None = None) -> tuple[int, int]:
    """INGEST_JOURNAL: one journald source within the contract's bounds (its unit lists come from
    ``p``). Returns (parsed, inserted); a failure of the source is raised."""
    config = {**source.config, "units": list(p.units), "exclude_units": list(p.exclude_units)}
    counts, errors = ingest_all(spark, [LogSource(source.name, "journald", True, config)], table_path, state_path, as_of,
                                p.since, p.limit, keys)
    if errors:
        raise ingest.UnreadableBatch(errors[source.name])
    return counts[source.name]
