"""Severity vocabulary as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.schema import ERROR_SEVERITIES, SEVERITY_ORDER, UNKNOWN_SEVERITY_RANK


def _literal_map(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def severity_rank(sev: Column) -> Column:
    """0 (emerg) … 7 (debug); any other value (or NULL) ranks 99."""
    m = _literal_map((name, i) for i, name in enumerate(SEVERITY_ORDER))
    return F.coalesce(F.try_element_at(m, sev), F.lit(UNKNOWN_SEVERITY_RANK))


def priority_to_severity(code: Column) -> Column:
    """journald PRIORITY / syslog PRI&7 (as text or number) -> name; unknown codes
    pass through as their own text."""
    code_s = code.cast("string")
    m = _literal_map((str(i), name) for i, name in enumerate(SEVERITY_ORDER))
    return F.coalesce(F.try_element_at(m, code_s), code_s)


def severity_at_most(sev: Column, threshold: str | None) -> Column | None:
    """Predicate "at least as severe as ``threshold``" (rank <= threshold rank).

    Threshold names are case-insensitive; an unknown threshold gives no predicate
    (the filter is ignored), as the reference does.
    """
    if threshold is None:
        return None
    t = threshold.strip().lower()
    if t not in SEVERITY_ORDER:
        return None
    return severity_rank(sev) <= F.lit(SEVERITY_ORDER.index(t))


def is_error_severity(sev: Column) -> Column:
    """err / crit / emerg (``alert`` is deliberately not an error here)."""
    return sev.isin(*ERROR_SEVERITIES)
