"""Small tables that are replaced as a whole: numbered versions, each put in place by one rename.

A writer first claims the next number by creating a file that must not exist yet, then reads the
newest version, and publishes its own. Two writers therefore never start from the same version:
the second waits until the first has published, or takes over when the claim has been left
for ``STALE_SECONDS``. Readers see the newest complete version. Older ones than the last two go.
"""

from __future__ import annotations

import os
import time
import uuid

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from timberline.session import discard, file_system

STALE_SECONDS = 600.0


def _names(spark: SparkSession, base: str, prefix: str) -> list[str]:
    fs, jpath = file_system(spark, base)
    if not fs.exists(jpath):
        return []
    return sorted(n for s in fs.listStatus(jpath) if (n := s.getPath().getName()).startswith(prefix))


def latest(spark: SparkSession, base: str) -> str | None:
    """The folder of the newest complete version."""
    names = _names(spark, base.rstrip("/"), "v-")
    return f"{base.rstrip('/')}/{names[-1]}" if names else None


def _create(spark: SparkSession, path: str) -> bool:
    """Create a file unless it exists, in one step; whether it was created."""
    fs, jpath = file_system(spark, path)
    fs.mkdirs(jpath.getParent())
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            os.close(os.open(jpath.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(jpath, False).close()
    except Py4JJavaError as exc:
        if "AlreadyExists" in exc.java_exception.getClass().getName():
            return False
        raise
    return True


def _claim(spark: SparkSession, base: str, wait: float) -> int:
    """Claim the next number: one writer gets it."""
    fs, _ = file_system(spark, base)
    end = time.monotonic() + wait
    while True:
        done = _names(spark, base, "v-")
        claims = _names(spark, base, "_claim-")
        newest = int(done[-1].removeprefix("v-")) if done else 0
        open_ = [int(c.removeprefix("_claim-")) for c in claims if int(c.removeprefix("_claim-")) > newest]
        number = max([newest, *open_]) + 1
        if open_:
            age = time.time() - fs.getFileStatus(file_system(spark, f"{base}/_claim-{max(open_):012d}")[1]).getModificationTime() / 1000
            if age < STALE_SECONDS:
                if time.monotonic() > end:
                    raise TimeoutError(f"another writer holds version {max(open_)} of {base}")
                time.sleep(0.1)
                continue
        if _create(spark, f"{base}/_claim-{number:012d}"):
            return number


def publish(spark: SparkSession, base: str, make: Callable[[str | None], DataFrame | None], wait: float = 60.0) -> str | None:
    """Write ``make(newest version or None)`` as the next version and return its folder. Nothing is
    published where ``make`` returns None or fails."""
    base = base.rstrip("/")
    number = _claim(spark, base, wait)
    mine = f"{base}/_claim-{number:012d}"
    aside = f"{base}/_next-{uuid.uuid4().hex}"
    try:
        rows = make(latest(spark, base))
        if rows is None:
            return None
        rows.write.parquet(aside)
        later = [c for c in _names(spark, base, "_claim-") if c > f"_claim-{number:012d}"]
        place = f"{base}/v-{number:012d}"
        fs, jplace = file_system(spark, place)
        # A rename onto an existing folder would move into it, unseen.
        if later or fs.exists(jplace) or not fs.rename(file_system(spark, aside)[1], jplace):
            raise OSError(f"the version {number} could not be put in place under {base}")
        for old in _names(spark, base, "v-")[:-2]:
            discard(spark, f"{base}/{old}")
        return place
    finally:
        discard(spark, mine)
        discard(spark, aside)
