"""Source-side row filters: look-back, unit include list, unit and container
globs, newest-N / first-N limits (S7–S11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import glob_to_regex, unit_glob_to_regex
from timberline.operators.window import in_window


def since_filter(df: DataFrame, as_of, since_seconds: int | None) -> DataFrame:
    """Entries newer than ``as_of - since`` (used when no cursor is known)."""
    return in_window(df, as_of, since_seconds)


def include_units(df: DataFrame, units) -> DataFrame:
    """Keep only the listed units; an empty list keeps everything."""
    units = list(units or [])
    return df.filter(F.col("unit").isin(*units)) if units else df


def _any_match(c: Column, regexes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(r) for r in regexes])


def exclude_units(df: DataFrame, patterns, unit_col: str = "unit") -> DataFrame:
    """Drop rows whose unit fully matches any pattern (only ``*`` is special).
    A NULL unit is matched as the empty string."""
    patterns = list(patterns or [])
    if not patterns:
        return df
    u = F.coalesce(F.col(unit_col), F.lit(""))
    literal = [p for p in patterns if "*" not in p]
    globs = [unit_glob_to_regex(p) for p in patterns if "*" in p]
    hit = F.lit(False)
    if literal:
        hit = hit | u.isin(*literal)
    if globs:
        hit = hit | _any_match(u, globs)
    return df.filter(~hit)


def container_glob_filter(df: DataFrame, include, exclude, name_col: str = "container") -> DataFrame:
    """Keep rows whose container name matches any include glob and no
    exclude glob (``*``, ``?``, ``[..]``). No include pattern keeps nothing."""
    include = list(include or [])
    exclude = list(exclude or [])
    name = F.col(name_col)
    if not include:
        return df.limit(0)
    keep = _any_match(name, [glob_to_regex(p) for p in include])
    if exclude:
        keep = keep & ~_any_match(name, [glob_to_regex(p) for p in exclude])
    return df.filter(F.coalesce(keep, F.lit(False)))


def newest(df: DataFrame, n: int | None, ts_col: str = "ts", tie_col: str | None = None) -> DataFrame:
    """S11 (journald ``-n N``): the newest ``n`` entries (top-k, not a full sort)."""
    if n is None:
        return df
    keys = [F.col(ts_col).desc()] + ([F.col(tie_col).desc()] if tie_col else [])
    return df.orderBy(*keys).limit(n)


def first_n(df: DataFrame, n: int | None, order_cols: list[str]) -> DataFrame:
    """S11 (files, containers): the first ``n`` parsed entries in input order."""
    if n is None:
        return df
    return df.orderBy(*order_cols).limit(n)
