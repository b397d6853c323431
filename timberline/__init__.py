"""timberline: log and host-telemetry analytics as PySpark DataFrame operators.

Every operator takes DataFrames, a parameter object and an explicit ``as_of``
timestamp and returns a DataFrame, so the same code runs in batch and (where it
makes sense) on streams. Nothing here reads the wall clock.
"""

from timberline.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
