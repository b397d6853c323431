"""Parameter objects with the reference's bounds.

Out-of-range values raise ``ValueError`` (never clamped); the bounds are part of
the query contract.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

DAY = 86400


def _check_int(name: str, value, lo: int, hi: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer")
    if value < lo or value > hi:
        raise ValueError(f"{name} must be between {lo} and {hi}")
    return value


def _check_str(name: str, value, max_len: int):
    if value is None:
        return None
    if not isinstance(value, str):
        raise ValueError(f"{name} must be a string")
    if len(value) > max_len:
        raise ValueError(f"{name} longer than {max_len}")
    return value


def as_timestamp(as_of) -> dt.datetime:
    """Normalise an ``as_of`` argument to a naive UTC datetime."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.datetime) and as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return as_of


@dataclass(frozen=True)
class LogQuery:
    since: int = 3600
    limit: int = 100
    order: str = "desc"
    min_severity: str | None = None
    source: str | None = None
    unit: str | None = None
    hostname: str | None = None
    contains: str | None = None
    literal_contains: bool = False  # escape % and _ in ``contains`` (D7)

    def __post_init__(self):
        _check_int("since", self.since, 1, 365 * DAY)
        _check_int("limit", self.limit, 1, 10000)
        _check_str("min_severity", self.min_severity, 20)
        _check_str("source", self.source, 100)
        _check_str("unit", self.unit, 100)
        _check_str("hostname", self.hostname, 255)
        _check_str("contains", self.contains, 500)
        if str(self.order).lower() not in ("asc", "desc"):
            object.__setattr__(self, "order", "desc")  # bad order -> desc
        else:
            object.__setattr__(self, "order", str(self.order).lower())


DISCOVER_KINDS = {
    "unit": "unit", "units": "unit",
    "hostname": "hostname", "hostnames": "hostname",
    "source": "source", "sources": "source",
    "severity": "severity", "severities": "severity",
}


@dataclass(frozen=True)
class Discover:
    kind: str
    since: int = DAY
    limit: int = 100

    def __post_init__(self):
        if not self.kind or self.kind.lower() not in DISCOVER_KINDS:
            raise ValueError("discover-kind-required")
        _check_int("since", self.since, 1, 365 * DAY)
        _check_int("limit", self.limit, 1, 10000)

    @property
    def column(self) -> str:
        return DISCOVER_KINDS[self.kind.lower()]


@dataclass(frozen=True)
class AnomalyParams:
    since: int = 3600
    error_spike_threshold: int = 10
    high_volume_threshold: int = 1000

    def __post_init__(self):
        _check_int("since", self.since, 1, 30 * DAY)


@dataclass(frozen=True)
class MetricQuery:
    metric_type: str | None = None
    since: int = 3600
    limit: int = 1000

    def __post_init__(self):
        _check_int("since", self.since, 1, 30 * DAY)
        _check_int("limit", self.limit, 1, 100000)
        _check_str("metric_type", self.metric_type, 50)


@dataclass(frozen=True)
class AlertQuery:
    since: int = DAY
    severity: str | None = None
    acknowledged: bool | None = None

    def __post_init__(self):
        _check_int("since", self.since, 1, 365 * DAY)
        _check_str("severity", self.severity, 20)


@dataclass(frozen=True)
class SearchParams:
    n_results: int = 10
    since: int | None = None
    source: str | None = None
    unit: str | None = None
    severity: str | None = None

    def __post_init__(self):
        _check_int("n_results", self.n_results, 1, 100)
        if self.since is not None:
            _check_int("since", self.since, 1, 365 * DAY)
        _check_str("source", self.source, 100)
        _check_str("unit", self.unit, 100)
        _check_str("severity", self.severity, 20)


@dataclass(frozen=True)
class IndexParams:
    since: int = DAY
    limit: int | None = None  # None: all pending rows; a caller's limit takes the newest

    def __post_init__(self):
        _check_int("since", self.since, 1, 365 * DAY)
        if self.limit is not None:
            _check_int("limit", self.limit, 1, 10**12)


@dataclass(frozen=True)
class ReportParams:
    since: int = DAY
    fmt: str = "text"

    def __post_init__(self):
        _check_int("since", self.since, 1, 365 * DAY)
        if self.fmt not in ("text", "html", "json"):
            raise ValueError("format must be text, html or json")


@dataclass(frozen=True)
class ChatParams:
    since: int = 3600
    context_size: int = 10

    def __post_init__(self):
        _check_int("since", self.since, 1, 30 * DAY)
        _check_int("context_size", self.context_size, 1, 50)


@dataclass(frozen=True)
class AuditHistoryParams:
    tool: str | None = None
    limit: int = 50

    def __post_init__(self):
        _check_int("limit", self.limit, 1, 1000)
        _check_str("tool", self.tool, 50)


@dataclass(frozen=True)
class IngestParams:
    since: int = 3600
    limit: int | None = None
    units: tuple = field(default_factory=tuple)
    exclude_units: tuple = field(default_factory=tuple)

    def __post_init__(self):
        _check_int("since", self.since, 1, 30 * DAY)
        if self.limit is not None:
            _check_int("limit", self.limit, 1, 100000)
