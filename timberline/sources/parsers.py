"""Line parsers: journald JSON, syslog, container logs, systemctl text.

Each parser maps a DataFrame with a text column (``value`` by default) to the
parsed log columns of ``schema.PARSED``; lines that do not parse are dropped.
``raw`` is always JSON text (X6): the journald line itself, or
``{"raw": line}`` for formats that are not JSON.
All parsing is built-in expressions (``from_json``, ``regexp_extract``,
``try_to_timestamp``), so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import priority_to_severity
from timberline.schema import JOURNALD, PARSED

# --- fixed values (patterns the reference's parsers use) ----------------------
# Syslog line as the reference matches it; the greedy program group swallows
# "[pid]" (D1), kept behind strict_compat=True.
SYSLOG_PATTERN_COMPAT = r"^<(\d+)>(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+)(?:\[(\d+)\])?:\s*(.*)$"
# Container runtime line: RFC 3339 time with fraction and Z, stream, message.
CONTAINER_PATTERN = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(stdout|stderr)\s+(.*)$"
# -----------------------------------------------------------------------------

# Our syslog pattern: the program stops before "[" so the pid is captured.
SYSLOG_PATTERN = r"^<(\d+)>(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+([^\s\[]+?)(?:\[(\d+)\])?:\s*(.*)$"


# Characters Python's str.strip() removes from log lines (ASCII whitespace).
_WHITESPACE = " \t\n\r\x0b\x0c"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITESPACE))


def _groups(line: Column, pattern: str, order: list[int]) -> tuple[Column, Column]:
    """One regex pass for several capture groups: rewrite a matching line to
    ``\n<g1>\n<g2>...`` and split it. Returns (matched, parts); a stripped
    line never starts with a newline, so the leading one marks a match. The
    last group may itself hold newlines (the split has a limit)."""
    rewritten = F.regexp_replace(line, pattern, "\n" + "\n".join(f"${g}" for g in order))
    return rewritten.startswith("\n"), F.split(rewritten, "\n", len(order) + 1)


def _wrapped(line: Column) -> Column:
    """X6 for a matched syslog / container line: such a line (``<pri>...`` or
    ``YYYY-MM-DDT...``) is never valid JSON, so it is always wrapped."""
    return F.to_json(F.struct(line.alias("raw")))


def _to_int(c: Column) -> Column:
    """Empty -> NULL; a value that is not an integer -> NULL."""
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c).try_cast("int")


def _finish(df: DataFrame, keep: list[str]) -> DataFrame:
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in PARSED.fields]
    return df.select(*cols, *[F.col(k) for k in keep if k in df.columns])


def parse_journald(lines: DataFrame, text_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Journald ``-o json`` lines -> log rows.

    Every field is read as text (journald writes numbers as strings; a number
    token is kept as its text). Bad JSON or a missing/invalid
    ``__REALTIME_TIMESTAMP`` drops the line. ``unit`` is ``_SYSTEMD_UNIT``, or
    ``SYSLOG_IDENTIFIER`` when that is empty or absent.
    """
    keep = keep or []
    # from_json stops at the end of the first object. Inside an array and inside another object,
    # text after it is an error in at least one of the two, so only whole lines pass both.
    one = F.from_json(F.concat(F.lit("["), F.col(text_col), F.lit("]")), T.ArrayType(JOURNALD))
    held = F.from_json(F.concat(F.lit('{"v":'), F.col(text_col), F.lit("}")), T.StructType([T.StructField("v", JOURNALD)]))
    lines = lines.select(F.col(text_col).alias("_line"), one.alias("_one"), held.alias("_held"), *[F.col(k) for k in keep])
    # Filters are not pushed below an explode, so a line is read as JSON once by each of the two and no more.
    j = F.explode_outer(F.when((F.size("_one") == 1) & F.col("_held.v").isNotNull(), F.col("_one")))
    df = lines.select("_line", j.alias("j"), *[F.col(k) for k in keep])
    micros = F.col("j.__REALTIME_TIMESTAMP").try_cast("long")
    df = df.select(
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"),
        F.col("j._HOSTNAME").alias("hostname"),
        F.lit("journald").alias("source"),
        F.coalesce(F.nullif(F.col("j._SYSTEMD_UNIT"), F.lit("")),
                   F.nullif(F.col("j.SYSLOG_IDENTIFIER"), F.lit(""))).alias("unit"),
        F.col("j.SYSLOG_FACILITY").alias("facility"),
        priority_to_severity(F.col("j.PRIORITY")).alias("severity"),
        _to_int(F.col("j._PID")).alias("pid"),
        _to_int(F.col("j._UID")).alias("uid"),
        _to_int(F.col("j._GID")).alias("gid"),
        F.col("j.MESSAGE").alias("message"),
        # A line that yields a timestamp parsed as a JSON object: keep it as is.
        F.col("_line").alias("raw"),
        F.nullif(F.col("j.__CURSOR"), F.lit("")).alias("cursor"),
        *[F.col(k) for k in keep])
    return _finish(df.filter(F.col("ts").isNotNull()), keep)


def parse_syslog(lines: DataFrame, year: int, text_col: str = "value",
                 strict_compat: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``<pri>Mon dd HH:MM:SS host prog[pid]: msg`` -> log rows.

    ``year`` is an argument (the line has none; the reference takes the wall
    clock's). Runs of blanks in the date are collapsed so ``Jan  1`` parses; an
    impossible date (Feb 30) drops the line. Severity is ``pri & 7``.
    """
    keep = keep or []
    # (?s): the message tail may hold any character, as Python's "." would.
    pat = "(?s)" + (SYSLOG_PATTERN_COMPAT if strict_compat else SYSLOG_PATTERN)
    line = _strip(F.col(text_col))
    matched, parts = _groups(line, pat, [1, 3, 4, 5, 6])
    df = lines.select(line.alias("_line"), matched.alias("_ok"), parts.alias("_p"), *[F.col(k) for k in keep])
    df = df.filter(F.col("_ok"))
    p = F.col("_p")
    # The date part is the only group that may contain blanks: its own extract.
    stamp = F.concat(F.lit(f"{int(year)} "),
                     F.regexp_replace(F.regexp_extract(F.col("_line"), pat, 2), r"\s+", " "))
    df = df.select(
        F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        p[2].alias("hostname"),
        F.lit("file").alias("source"),
        p[3].alias("unit"),
        priority_to_severity(p[1].try_cast("long").bitwiseAND(F.lit(7))).alias("severity"),
        F.when(p[4] == "", F.lit(None)).otherwise(p[4]).try_cast("int").alias("pid"),
        p[5].alias("message"),
        _wrapped(F.col("_line")).alias("raw"),
        *[F.col(k) for k in keep])
    return _finish(df.filter(F.col("ts").isNotNull()), keep)


def parse_container(lines: DataFrame, container_col: str = "container", text_col: str = "value",
                    hostname: str | Column = "localhost", keep: list[str] | None = None) -> DataFrame:
    """S3: ``<RFC3339 ts> stdout|stderr msg`` -> log rows; stdout is info, stderr
    warning (X8); ``unit`` is the container name. Fractions beyond µs truncate."""
    keep = keep or []
    line = _strip(F.col(text_col))
    host = hostname if isinstance(hostname, Column) else F.lit(hostname)
    matched, parts = _groups(line, "(?s)" + CONTAINER_PATTERN, [1, 2, 3])
    df = lines.select(line.alias("_line"), matched.alias("_ok"), parts.alias("_p"),
                      F.col(container_col).alias("_container"), host.alias("_host"), *[F.col(k) for k in keep])
    p = F.col("_p")
    df = df.filter(F.col("_ok")).select(
        F.regexp_replace(p[1], "Z$", "").try_cast("timestamp_ntz").alias("ts"),
        F.col("_host").alias("hostname"),
        F.lit("container").alias("source"),
        F.coalesce(F.col("_container"), F.lit("unknown")).alias("unit"),
        F.when(p[2] == "stdout", F.lit("info")).otherwise(F.lit("warning")).alias("severity"),
        p[3].alias("message"),
        _wrapped(F.col("_line")).alias("raw"),
        *[F.col(k) for k in keep])
    return _finish(df.filter(F.col("ts").isNotNull()), keep)


def parse_service_status(lines: DataFrame, capture_cols: list[str], text_col: str = "value",
                         line_no_col: str = "line_no") -> DataFrame:
    """``systemctl list-units`` captures -> (service_name, load_state,
    active_state, sub_state).

    ``capture_cols`` identify one captured output (e.g. host and snapshot
    time); its first line (lowest ``line_no``) is the header and is skipped.
    Blank lines and lines with fewer than four blank-separated fields are
    dropped. The header position is a grouped min joined back on the capture
    key (one row per capture on the small side).
    """
    first = lines.groupBy(*capture_cols).agg(F.min(line_no_col).alias("_first"))
    parts = F.split(F.trim(F.col(text_col)), r"\s+")
    df = (lines.join(first, capture_cols, "inner")
          .filter((F.col(line_no_col) != F.col("_first")) & (F.trim(F.col(text_col)) != ""))
          .withColumn("_p", parts).filter(F.size("_p") >= 4))
    return df.select(*capture_cols, F.col(line_no_col),
                     F.col("_p")[0].alias("service_name"), F.col("_p")[1].alias("load_state"),
                     F.col("_p")[2].alias("active_state"), F.col("_p")[3].alias("sub_state"))
