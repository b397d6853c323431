"""Text helpers: glob patterns, LIKE escaping, search text, JSON wrapping,
percentages and report formatting (X6, X9, X11, X16, X17)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.fingerprint import py_str


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by the text of ``values[name]``
    (a column expression; NULL makes the whole result NULL, as ``concat`` does)."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(parts)]
    return F.concat(*[p for i, p in enumerate(pieces) if i % 2 == 1 or parts[i] != ""])


def glob_to_regex(pattern: str) -> str:
    """fnmatch-style glob (``*``, ``?``, ``[..]``, ``[!..]``) -> anchored Java regex.

    Built once on the driver; the match itself runs as ``rlike`` on executors.
    """
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
            else:
                body = pattern[i:j].replace("\\", "\\\\")
                i = j + 1
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append(f"[{body}]")
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def unit_glob_to_regex(pattern: str) -> str:
    """Unit exclusion pattern: only ``*`` is special, the match is on the whole name."""
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def escape_like(text: str) -> str:
    """Escape ``\\``, ``%`` and ``_`` so a LIKE pattern matches ``text`` literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_text(hostname: Column, unit: Column, message: Column) -> Column:
    """``[host] unit: message``; the host prefix only when the host is non-empty."""
    body = F.concat(py_str(unit), F.lit(": "), py_str(message))
    return F.when(F.coalesce(hostname, F.lit("")) != F.lit(""),
                  F.concat(F.lit("["), hostname, F.lit("] "), body)).otherwise(body)


def json_or_wrap(raw: Column) -> Column:
    """Keep ``raw`` when it is valid JSON, else wrap it as ``{"raw": text}``."""
    return F.when(raw.isNull(), F.lit(None).cast("string")) \
            .when(F.try_parse_json(raw).isNotNull(), raw) \
            .otherwise(F.to_json(F.struct(raw.alias("raw"))))


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """``part / total * 100`` rounded half-up, 0.0 when ``total`` is 0."""
    return F.when(total > 0, F.round(part.cast("double") / total * 100.0, digits)) \
            .otherwise(F.lit(0.0))


def thousands(n: Column) -> Column:
    """Integer with thousands separators (``1,234``)."""
    return F.format_number(n.cast("long"), 0)


def html_escape(s: Column) -> Column:
    out = F.regexp_replace(s, "&", "&amp;")
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.regexp_replace(out, a, b)
    return out
