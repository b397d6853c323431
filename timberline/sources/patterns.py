"""Named-field line patterns (P1): a format written as a line, compiled to column expressions.

A pattern is the line itself with fields in braces: ``{name}`` or ``{name:kind}``. Names are those
of the parsed log columns (``ts``, ``hostname``, ``unit``, ``facility``, ``severity``, ``pid``, ``uid``, ``gid``,
``message``, ``cursor``, ``source``); ``{_}`` is read and dropped. ``[[...]]`` may be absent. A blank stands
for one or more. Kinds:

* ``word`` (default): no blanks, as short as the text behind allows; ``text``: anything, also empty;
* ``int``: digits; ``iso``: an ISO 8601 time, UTC unless it names an offset; ``epoch``: seconds since 1970;
* ``time(<pattern>)``: a time by a Spark datetime pattern;
* ``level``: a severity by name (``WARN``, ``error``, ``Critical``...), ``pri``: by a syslog priority.

The whole line is matched once and every field is a built-in expression of its group, so such a
parser runs without Python workers: ``register_parser("app", pattern_parser("{ts:iso} ..."))``.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import priority_to_severity
from timberline.schema import PARSED
from timberline.sources.parsers import _finish, _groups, _strip, _to_int, _wrapped

FIELD = re.compile(r"\{([A-Za-z_]+)(?::(\w+)(?:\((.*?)\))?)?\}")
KINDS = {
    "word": r"\S+?", "text": r".*?", "int": r"\d+", "epoch": r"\d+(?:\.\d+)?", "time": r".+?", "level": r"[A-Za-z]+", "pri": r"\d+",
    "iso": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+\-]\d{2}:?\d{2})?",
}
#: Names of levels beside the severities' own.
LEVELS = {"emergency": "emerg", "panic": "emerg", "fatal": "crit", "critical": "crit", "error": "err", "warn": "warning",
          "informational": "info", "information": "info", "trace": "debug"}


def _literal(text: str) -> str:
    return re.sub(r"(\\?\s)+", r"\\s+", re.escape(text))


def _compile(pattern: str) -> tuple[str, list[tuple[str, str, str | None]]]:
    """The regular expression of a pattern and its fields: (name, kind, argument) by group."""
    if pattern.count("[[") != pattern.count("]]"):
        raise ValueError("[[ and ]] must come in pairs")
    fields, out = [], "^"
    known = {f.name for f in PARSED.fields}
    for part in re.split(r"(\[\[|\]\](?!\])|\{[^{}]*\})", pattern):
        if part == "[[":
            out += "(?:"
        elif part == "]]":
            out += ")?"
        elif m := FIELD.fullmatch(part):
            name, kind, arg = m[1], m[2] or "word", m[3]
            if kind not in KINDS or (kind == "time") != bool(arg):
                raise ValueError(f"unknown kind in {part}")
            if name == "_":
                out += f"(?:{KINDS[kind]})"
                continue
            if name not in known or any(name == f[0] for f in fields):
                raise ValueError(f"{part} names no column of a log row, or one twice")
            fields.append((name, kind, arg))
            out += f"({KINDS[kind]})"
        elif part.startswith("{"):
            raise ValueError(f"cannot read the field {part}")
        else:
            out += _literal(part)
    if "ts" not in [f[0] for f in fields]:
        raise ValueError("a pattern needs a {ts} field")
    return out + "$", fields


def _value(text: Column, kind: str, arg: str | None) -> Column:
    if kind == "int":
        return _to_int(text)
    if kind == "iso":
        return F.try_to_timestamp(F.regexp_replace(text, ",", ".")).cast("timestamp_ntz")
    if kind == "epoch":
        return F.timestamp_micros((text.try_cast("decimal(20,6)") * 1000000).cast("long")).cast("timestamp_ntz")
    if kind == "time":
        return F.try_to_timestamp(text, F.lit(arg)).cast("timestamp_ntz")
    if kind == "pri":
        return priority_to_severity(text.try_cast("int").bitwiseAND(7).cast("string"))
    if kind == "level":
        names = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
        return F.coalesce(F.element_at(names, F.lower(text)), F.lower(text))
    return F.nullif(text, F.lit("")) if kind == "word" else text


def pattern_parser(pattern: str, source: str | None = None) -> Callable[[DataFrame, dict], DataFrame]:
    """A parser for ``register_parser`` from a line pattern. Lines that do not match, or whose
    time cannot be read, are dropped; an absent optional field is NULL; ``source`` is the row's
    source where the pattern does not read it."""
    regex, fields = _compile(pattern)

    def run(lines: DataFrame, config: dict) -> DataFrame:
        keep = [c for c in lines.columns if c != "value"]
        line = _strip(F.col("value"))
        matched, parts = _groups(line, regex, list(range(1, len(fields) + 1)))
        df = lines.select(line.alias("_line"), matched.alias("_ok"), parts.alias("_p"), *keep).filter("_ok")
        columns = [_value(F.get("_p", i + 1), kind, arg).alias(name) for i, (name, kind, arg) in enumerate(fields)]
        if source is not None and "source" not in [f[0] for f in fields]:
            columns.append(F.lit(source).alias("source"))
        df = df.select(*columns, _wrapped(F.col("_line")).alias("raw"), *keep)
        return _finish(df.filter(F.col("ts").isNotNull()), keep)

    return run
