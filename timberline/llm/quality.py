"""Quality rules as a bitmask ledger.

``ledger`` measures every document once and stores one failure bit for each rule beside the
measurements. A policy is a versioned set of rules; ``apply_policy`` and ``ablation`` read the
stored bits only, so a new policy version never reads a text again.

Defined results: a null text is empty; empty texts have zero words and fail the length rule;
repeated rows are judged one by one; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ROW, giving_back, nest, small_batches
from timberline.llm.words import SPACED, per_text, slices, split_words, spread, text_buffers

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter",
            "n_letters", "n_upper", "n_unsegmented")
REPEAT_WINDOW = 5


def rules() -> dict[str, Column]:
    """Rule name to failure condition, in bit order (bit i is rule i)."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return {
        "too_few_words": n < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > 2 * n,
        "duplicate_lines": (lines >= 4) & (100 * F.col("n_dup_lines") > 30 * lines),
        "long_words": F.col("word_chars") > 25 * n,
        "short_words": F.col("word_chars") < 2 * n,
        "few_letters": 10 * F.col("n_letters") < 5 * F.col("word_chars"),
        "stutter": 100 * F.col("n_stutter") > 30 * n,
        "shouting": (n >= 10) & (10 * F.col("n_upper") > 7 * F.col("n_letters")),
        # Scripts without blanks between words: their blank-separated words are clauses.
        "long_segmented_words": (F.col("word_chars") > 25 * n) & (2 * F.col("n_unsegmented") <= F.col("n_letters")),
    }


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules: a document is rejected if it fails any of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(rules())
        return sum(1 << names.index(r) for r in self.rules)


BASE_RULES = ("too_few_words", "repeated_windows")
POLICIES = {
    "base-1": Policy("base-1", BASE_RULES),
    "full-1": Policy("full-1", (*BASE_RULES, "symbols", "duplicate_lines", "long_words", "short_words",
                                "few_letters", "stutter", "shouting")),
    "full-2": Policy("full-2", (*BASE_RULES, "symbols", "duplicate_lines", "long_segmented_words", "short_words",
                                "few_letters", "stutter", "shouting")),
}
DEFAULT_POLICY = "full-2"


def _byte_set(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[list(chars.encode())] = True
    return m


_SYMBOL = _byte_set("#*$%&|<>")
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC0:] = True  # first bytes of code points beyond ASCII
#: First and last code points of scripts written without blanks between words: Thai, Lao and
#: Tibetan; Myanmar; Khmer; Tai Le and New Tai Lue; Tai Tham; Balinese; kana, Bopomofo, ideographs
#: and Yi; Javanese and Myanmar; Tai Viet; ideographs; halfwidth kana; kana; ideographs.
_UNSEGMENTED = np.array([
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
    (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)])


def _unsegmented(body: np.ndarray) -> np.ndarray:
    """Where a code point of a script without blanks between words begins."""
    out = np.zeros(len(body), dtype=bool)
    at = np.flatnonzero(body >= 0xE0)
    if not len(at):
        return out
    b = [body[np.minimum(at + k, len(body) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    point = np.where(body[at] < 0xF0, (b[0] & 0x0F) << 12 | b[1] << 6 | b[2], (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3])
    k = np.searchsorted(_UNSEGMENTED[:, 0], point, side="right") - 1
    out[at] = (k >= 0) & (point <= _UNSEGMENTED[k, 1])
    return out


def _repeated(windows: np.ndarray, ok: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a window begins that occurs at least twice in its own text."""
    key = windows ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key[ok])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(key), dtype=bool)
    at = np.searchsorted(twice, key)
    return ok & (twice[np.minimum(at, len(twice) - 1)] == key)


def measure_texts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of consecutive texts, one array entry for each text."""
    w = split_words(data, bounds, SPACED)
    windows, ok = w.windows(REPEAT_WINDOW)
    covered = spread(_repeated(windows, ok, w.text_of_word()), REPEAT_WINDOW)
    again = np.zeros(len(w.hash), dtype=bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[:-1][w.counts > 0]] = False
    body = data[bounds[0] : bounds[-1]]
    at = bounds - bounds[0]
    lines, dups = [], []
    whole = body.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = [x for x in whole[a:b].split(b"\n") if x.strip()]
        lines.append(len(own))
        dups.append(len(own) - len(set(own)) if len(own) > 1 else 0)
    return {
        "n_words": w.counts,
        "word_chars": per_text(_LEAD[body] & SPACED.is_word[body], at),
        "n_symbols": per_text(_SYMBOL[body], at),
        "n_lines": np.array(lines, dtype=np.int64),
        "n_dup_lines": np.array(dups, dtype=np.int64),
        "n_repeat_words": per_text(covered, w.first),
        "n_stutter": per_text(again, w.first),
        "n_letters": per_text(_LETTER[body], at),
        "n_upper": per_text(_UPPER[body], at),
        "n_unsegmented": per_text(_unsegmented(body), at),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = text_buffers(b.column(1))
        parts = [measure_texts(data, bounds[lo : hi + 1]) for lo, hi in slices(bounds)]
        values = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, type=pa.int64()) for v in values]],
                                         names=[ROW, *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One pass over the texts: each document's own columns (nested), the measurements and
    ``fail_bits`` with bit i set if rule i of ``rules()`` fails."""
    small_batches(docs.sparkSession)
    rows = nest(docs).select(ROW, F.col(f"{ROW}.text").cast("string").alias("text"))
    kind = rows.schema[ROW].dataType.simpleString()
    schema = f"{ROW} {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = rows.mapInArrow(giving_back(_measure), schema)
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(rules().values())]
    return measured.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Add ``kept`` and ``policy`` to a ledger, from its stored bits alone."""
    rejected = F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0
    return entries.withColumn("kept", ~rejected).withColumn("policy", F.lit(policy.version))


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents failing it, and documents failing it alone (those
    that come back if the rule is dropped). One aggregate over the bits, a row for each rule."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    names = list(rules())
    counts = []
    for r in policy.rules:
        bit = 1 << names.index(r)
        counts.append(F.struct(F.lit(r).alias("rule"), F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
                               F.count_if(hit == F.lit(bit)).alias("n_failed_alone")))
    total = entries.agg(F.array(*counts).alias("r"))
    return total.select(F.explode("r").alias("r")).select("r.*", F.lit(policy.version).alias("policy"))
