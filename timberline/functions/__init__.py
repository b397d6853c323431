"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from timberline.functions.severity import (
    severity_rank, priority_to_severity, severity_at_most, is_error_severity,
)
from timberline.functions.fingerprint import (
    py_str, py_ts_str, fingerprint, id_from_fingerprint, with_fingerprint,
)
from timberline.functions.text import (
    fill, glob_to_regex, unit_glob_to_regex, escape_like, search_text, json_or_wrap,
    percent, html_escape, thousands,
)

__all__ = [
    "severity_rank", "priority_to_severity", "severity_at_most", "is_error_severity",
    "py_str", "py_ts_str", "fingerprint", "id_from_fingerprint", "with_fingerprint",
    "fill", "glob_to_regex", "unit_glob_to_regex", "escape_like", "search_text", "json_or_wrap",
    "percent", "html_escape", "thousands",
]
