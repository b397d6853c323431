"""Fill-in-the-middle transformation: texts are cut into prefix, middle and suffix at code
points found by select over SWAR words.

The UTF-8 bytes of a slice of texts are viewed as 64-bit words. Arithmetic on a whole word marks
the bytes that end a code point (those before a byte that starts one); ``bitwise_count`` gives
the marks of each word and their running sum. The k-th code point of a text ends in the word that
a binary search in the running sum finds, and inside the word a multiplication sums the marks
byte by byte, so that comparing the eight sums with the rank left over names the byte. Cuts are
therefore two searches a text, however long it is, and no text is decoded.

Python returns three numbers a text; Spark cuts and joins the parts on the bytes.

Defined results: a null text counts as empty, an empty text stays plain with n = 0; a null doc_id
counts as an empty string in the draw. Repeated rows are drawn alike. Bytes that are not valid
UTF-8 belong to the code point before them. Columns of the input are kept in one struct, so
none can clash with a result. Empty tables give empty results. A single text may be as long as
an Arrow string column allows (2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ROW, nest, small_batches
from timberline.llm.words import SLICE, slices, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # draws of 100 from here on leave a text plain
SPM_BELOW = 20  # draws of 100 below this put the suffix first

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_ONE, _SEVEN, _EIGHT, _TOP = (np.uint64(x) for x in (1, 7, 8, 56))


class CodePoints:
    """Rank and select over the code points of consecutive UTF-8 texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.at = bounds - bounds[0]
        size = int(self.at[-1])
        padded = np.zeros(-(-size // 8) * 8 + 8, dtype=np.uint8)
        padded[:size] = data[bounds[0] : bounds[-1]]
        word = padded.view("<u8")
        # A continuation byte has its high bit set and the next one clear: 10xxxxxx.
        starts = ~(word & (~word << _ONE)) & _HIGH
        ends = starts >> _EIGHT
        ends[:-1] |= starts[1:] << _TOP
        marks = ends.view(np.uint8)
        marks[size:] = 0
        last = self.at[1:][self.at[1:] > self.at[:-1]] - 1
        marks[last] = 0x80  # a text ends its last code point whatever follows it
        self.ends = ends >> _SEVEN
        self.total = np.zeros(len(ends) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(ends), out=self.total[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (_ONE << (byte << np.uint64(3))) - _ONE
        return self.total[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th code point (k from 1)."""
        word = np.searchsorted(self.total, k, side="left") - 1
        left = (k - self.total[word]).astype(np.uint64)
        sums = self.ends[word] * _ONES  # byte i: marks of bytes 0 to i
        reached = ((sums | _HIGH) - left * _ONES) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached) + 1

    def cuts(self, draw1: np.ndarray, draw2: np.ndarray) -> tuple[np.ndarray, ...]:
        """Code points of each text, the smaller and larger cut, and the cuts in bytes."""
        before = self.rank(self.at[:-1])
        n = self.rank(self.at[1:]) - before
        one, two = draw1 % (n + 1), draw2 % (n + 1)
        first, second = np.minimum(one, two), np.maximum(one, two)
        size = [np.where(c > 0, self.select(np.maximum(before + c, 1)) - self.at[:-1], 0) if len(n) and self.total[-1]
                else np.zeros_like(n) for c in (first, second)]
        return n, first, second, *size


def cut_points(text: pa.Array, draw1: np.ndarray, draw2: np.ndarray, slice_bytes: int = SLICE) -> list[np.ndarray]:
    """``CodePoints.cuts`` of a column of texts, slice by slice."""
    data, bounds = text_buffers(text)
    parts = [CodePoints(data, bounds[lo : hi + 1]).cuts(draw1[lo:hi], draw2[lo:hi]) for lo, hi in slices(bounds, slice_bytes)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 5


_CUTS = "n long, first long, second long, first_byte int, second_byte int"


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, one, two in batches:
        n, first, second, *at = cut_points(text, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))
        yield pa.StructArray.from_arrays([pa.array(n), pa.array(first), pa.array(second),
                                          *[pa.array(c.astype(np.int32)) for c in at]],
                                         names=["n", "first", "second", "first_byte", "second_byte"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws: the first 8-digit groups of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``row__`` (the document), ``n`` code points, ``form`` (plain, psm or spm),
    ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output`` text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"{ROW}.text").cast("string"), F.lit(""))
    drawn = [h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col(f"{ROW}.doc_id"), seed))]
    rows = nest(docs).select(ROW, text.alias("text"), *drawn).withColumn(
        "cut", F.arrow_udf(_cuts, _CUTS)("text", "h1", "h2"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= plain_from), "plain") \
        .when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    raw = F.col("text").cast("binary")

    def part(start: Column, end: Column) -> Column:
        return F.substring(raw, start + 1, end - start).cast("string")

    first, second = F.col("cut.first_byte"), F.col("cut.second_byte")
    prefix, middle = part(F.lit(0), first), part(first, second)
    suffix = part(second, F.octet_length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")) \
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)) \
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        ROW, F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.first")).alias("prefix_chars"),
        F.when(cut, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Each mark occurs once in an output that is not
    plain, because no such text holds one and no mark begins as another ends."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, left, -1), right, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
