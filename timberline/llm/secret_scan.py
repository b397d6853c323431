"""Secret scan: high-recall candidates, and a random forest that removes false positives.

``candidates`` finds what a credential name is assigned (a whole quoted string or non-blank word,
at any length), links with a password, and runs of 8 or more key-like characters that hold a
digit, mix their cases or are assigned; with the name a value is assigned to and its neighbouring
words. An unquoted value that ends in sentence marks is found with and without them. Runs without
a digit and of one case, and values with other marks and no credential name before them, are not
candidates as a whole. The forest judges a candidate by its length, its
character mix and transitions, how much of it dictionary words cover, and how often its path and
its neighbours came with real secrets. It is trained on labelled findings: any table of
candidates with a ``label``; ``rule_labels`` makes one from formats that leave no doubt.

The labelled sample is bounded (about ``SAMPLE`` rows of either label, by a hash); candidate
search and prediction read every whole text.

Defined results: null and empty texts have no candidates; without labels of both kinds every
candidate scores 0.5 and is kept; a null path is a path of its own; repeated rows give their
candidates again.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import land, nest, small_batches
from timberline.llm.words import text_buffers

SAMPLE = 4000
TREES = 40
DEPTH = 8
MIN_LENGTH = 8  # of runs that no credential name is assigned
DEEPEST = 8
_RUN = re.compile(rb"[A-Za-z0-9+/_=.@:\-]{8,}")
_DIGIT = re.compile(rb"\d")
#: A value holds more than marks: the '=' that end a base64 run are its padding.
_ASSIGNED = re.compile(r"([A-Za-z][A-Za-z0-9_.\-]{1,40})[=:]++(.+)", re.S)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = re.compile(rb"[a-z]")
_UPPER = re.compile(rb"[A-Z]")
#: A credential name and what assigns it: '=', ':', '=>', or a type and '='.
_NAMED = re.compile(rb"((?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
                    rb"[A-Za-z0-9_.\-]{0,100}+)(?:\\*[\"'`])?\]?[ \t]*+"
                    rb"(?::[ \t]*[A-Za-z_][A-Za-z0-9_.\[\]]{0,100}[ \t]+=[ \t]+|:?=+>?|:+)[ \t]*+", re.I)
_NAME_LEFT = re.compile(rb"[A-Za-z0-9_.\-]+\Z")
#: A quoted value, read once from left to right: a backslash takes the next character with it; if no
#: quote closes the value that way, backslashes are characters like others.
_QUOTED = re.compile(rb"(\\*[\"'`])((?:(?!\1)(?:\\[^\n]|[^\n\\]))++)\1")
_QUOTED_PLAIN = re.compile(rb"(\\*[\"'`])((?:(?!\1)[^\n])++)\1")
#: An unquoted value: to the next blank, or to a mark behind which another name is assigned.
_BARE = re.compile(rb"(?:(?![&;,][\"']?[A-Za-z_][A-Za-z0-9_.\-]{0,100}[\"']?[=:])[^\x20\x09-\x0D])+")
_OPEN = re.compile(rb"[\[{(]+(?:[\\\"'`]|\s)")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_NESTED = re.compile(rb"[\"'`{}\[\]()<>=]")
#: A link with a password before its host.
_URL = re.compile(rb"[A-Za-z][A-Za-z0-9+.\-]{1,30}://[^\x00-\x20/?#@:\"'<>`]*:[^\x00-\x20/\"'<>`]+@[^\x00-\x20\"'<>`]*")
#: Names whose assigned values are credentials, and formats that are (fixed values).
NAMES = r"(?i).*(password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential).*"
KEY_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})$"
#: Formats that are not: addresses, numbers, mail, links, versions (fixed values).
HARMLESS = r"^([0-9 .:+\-/]+|[^@]+@[^@]+\.[A-Za-z]+\.?|(https?:|www\.).*)$"
#: Links that hold a password are not harmless.
URL_PASSWORD = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#@:]*:[^\s/]+@.*$"
URL_SECRET = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#@:]*:[^\s/]*\d[^\s/]*@.*$"
#: Words that make a value readable; a parameter of ``fit`` and ``scan``.
DICTIONARY = ("password", "example", "sample", "test", "your", "change", "secret", "token", "value", "user", "admin", "name",
              "file", "data", "http", "www", "com", "org", "net", "mail", "version", "license", "the", "and", "this", "that",
              "with", "from", "key", "null", "none", "true", "false", "default", "dummy", "placeholder")
FEATURES = ("length", "digits", "uppers", "lowers", "others", "entropy", "transitions", "repeats", "coverage", "named",
            "name_odds", "before_odds", "after_odds", "path_odds")
CANDIDATE_SQL = "doc_id {}, path string, at long, name string, value string, before string, after string"


def _neighbours(text: bytes, a: int, b: int) -> tuple[str, str, str]:
    """The name a run is assigned to if it stands before it, and the words on either side."""
    before = _WORD.findall(text[max(0, a - 200) : a])[-3:]
    after = _WORD.findall(text[b : b + 100])[:2]
    left = [w.decode("utf-8", "ignore").strip("\"'`.,;()").lower() for w in before]
    right = [w.decode("utf-8", "ignore").strip("\"'`.,;()").lower() for w in after]
    gap = text[max(0, a - 200) : a].rstrip(b" \t\"'")
    name = ""
    if gap.endswith((b"=", b":")):
        named = [w for w in left if w.strip("=:")]
        name = named[-1].rstrip("=:") if named else ""
    words = [w for w in left if w.strip("=:")]
    right = [w for w in right if w]
    return name, words[-1] if words else "", right[0] if right else ""


def _named_values(text: bytes) -> Iterator[tuple[int, int, int, str, bool]]:
    """(begin of the name, begin and end of the value, name, whether runs inside are pieces of it)
    of each value that a credential name is assigned."""
    pos, inside, depth = 0, 0, 0
    while m := _NAMED.search(text, pos):
        pos = m.end()
        depth = depth + 1 if m.start() < inside else 0
        if depth > DEEPEST:  # names in values in values: no more than a fixed number of times
            pos = inside
            continue
        if _OPEN.match(text, m.end()):  # a list or an object: its own names and runs are found
            continue
        lead = _NAME_LEFT.search(text, max(0, m.start() - 200), m.start())
        begin = lead.start() if lead else m.start()
        name = (text[begin : m.start()] + m[1]).decode().lower().lstrip("_.-")
        quoted = _QUOTED.match(text, m.end()) or _QUOTED_PLAIN.match(text, m.end())
        if quoted:
            yield begin, *quoted.span(2), name, not _GAP.search(quoted[2])
        elif word := _BARE.match(text, m.end()):
            whole = not _NESTED.search(word.group())
            inside = max(inside, word.end())
            yield begin, *word.span(), name, whole
            short = word.group().rstrip(b".,;:)]}>\"'`")
            if short and len(short) < len(word.group()):
                yield begin, word.start(), word.start() + len(short), name, whole


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans with overlapping ones joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _mixed(value: bytes) -> bool:
    """Whether a run without a digit has lower-case letters, and upper-case ones after its first."""
    return bool(_LOWER.search(value) and _UPPER.search(value, 1))


def find(text: bytes) -> Iterator[tuple[int, str, str, str, str]]:
    """(byte offset, name, value, word before, word after) of each candidate in a text."""
    whole: list[tuple[int, int]] = []  # spans inside which runs are pieces of a candidate
    done: set[tuple[int, int]] = set()
    for begin, a, b, name, covers in _named_values(text):
        _, before, after = _neighbours(text, begin, b)
        done.add((a, b))
        if covers:
            whole.append((begin, b))
        yield a, name, text[a:b].decode("utf-8", "replace"), before, after
    named = _union(whole)
    for m in _URL.finditer(text):
        a, b = m.start(), m.end() - (len(m.group()) - len(m.group().rstrip(b".:,;)")))
        k = bisect(named, (a, len(text))) - 1
        if k >= 0 and b <= named[k][1]:
            continue
        name, before, after = _neighbours(text, a, b)
        whole.append((a, m.end()))
        yield a, name, text[a:b].decode("utf-8", "replace"), before, after
    whole = _union(whole)
    for m in _RUN.finditer(text):
        run = m.group()
        value = run.rstrip(b".:")
        assigned = _ASSIGNED.fullmatch(value.decode())
        name, before, after = "", "", ""
        at = m.start()
        if assigned:
            at += len(value) - len(assigned[2].encode())
        elif not _DIGIT.search(value) and not _mixed(value):
            gap = text[max(0, m.start() - 8) : m.start()].rstrip(b" \t\"'")
            if not gap.endswith((b"=", b":")):
                continue
        if assigned:
            value = assigned[2].encode()
        k = bisect(whole, (at, len(text))) - 1
        if (k >= 0 and at + len(value) <= whole[k][1]) or (at, at + len(value)) in done:
            continue
        name, before, after = _neighbours(text, m.start(), m.end())
        if assigned:
            name = assigned[1].lower()
        if len(value) >= MIN_LENGTH:
            yield at, name, value.decode(), before, after


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = text_buffers(b.column(2))
        row, rest = [], []
        for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            for found in find(data[x:y].tobytes()):
                row.append(i)
                rest.append(found)
        take = pa.array(row, pa.int64())
        columns = list(zip(*rest, strict=True)) if rest else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "path", "at", "name", "value", "before", "after"])


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """Every candidate of every text: document, path, byte offset, name, value, neighbours."""
    small_batches(docs.sparkSession)
    rows = nest(docs).select("row__.doc_id", F.col(f"row__.{path}").cast("string").alias("path"),
                             F.col("row__.text").cast("string").alias("text"))
    return rows.mapInArrow(_finder, CANDIDATE_SQL.format(rows.schema["doc_id"].dataType.simpleString()))


def rule_labels() -> Column:
    """1: a format or name that leaves no doubt; 0: a harmless format; null: not labelled."""
    bare = F.regexp_replace("value", r"[.,;:)\]}>\"'`]+$", "")
    return F.when(F.col("value").rlike(KEY_FORMATS) | F.col("value").rlike(URL_SECRET), 1).when(
        (F.col("value").rlike(HARMLESS) | bare.rlike(HARMLESS)) & ~F.col("value").rlike(URL_PASSWORD), 0).when(
        F.col("name").rlike(NAMES) & F.col("value").rlike(r"\d"), 1)


def _kind(c: str) -> int:
    """Character classes of transitions: hex digits apart from other digits and letters."""
    if c.isdigit():
        return 0
    if "a" <= c <= "f":
        return 1
    if "g" <= c <= "z":
        return 2 if c in "aeiou" else 3
    if "A" <= c <= "F":
        return 4
    if "G" <= c <= "Z":
        return 5
    return 6 if c in ".@" else 7


class Odds:
    """What the labelled findings say about transitions, names, neighbours and paths."""

    def __init__(self, rows: list, dictionary: tuple[str, ...]):
        self.dictionary = [w for w in dictionary if len(w) >= 3]
        n = [max(1, sum(1 for r in rows if r.label == y)) for y in (0, 1)]
        move = np.ones((2, 8, 8))
        seen: dict[str, list[Counter]] = {k: [Counter(), Counter()] for k in ("name", "before", "after", "path")}
        for r in rows:
            k = [_kind(c) for c in r.value]
            np.add.at(move[r.label], (k[:-1], k[1:]), 1)
            for field, counts in seen.items():
                counts[r.label][r[field] or ""] += 1
        share = move / move.sum(axis=2, keepdims=True)
        self.move = np.log(share[1] / share[0])
        self.odds = {f: {w: math.log((c[1][w] + 0.5) / (n[1] + 1) / ((c[0][w] + 0.5) / (n[0] + 1))) for w in c[0] | c[1]
                         if c[0][w] + c[1][w] >= 3} for f, c in seen.items()}

    def coverage(self, value: str) -> float:
        low, hit = value.lower(), np.zeros(len(value), dtype=bool)
        for w in self.dictionary:
            i = low.find(w)
            while i >= 0:
                hit[i : i + len(w)] = True
                i = low.find(w, i + 1)
        return float(hit.mean())

    def features(self, path: str, name: str, value: str, before: str, after: str) -> list[float]:
        n = len(value)
        share = [c / n for c in Counter(value).values()]
        k = [_kind(c) for c in value]
        move = float(self.move[k[:-1], k[1:]].mean()) if n > 1 else 0.0
        return [float(n), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n,
                sum(c.islower() for c in value) / n, sum(not c.isalnum() for c in value) / n,
                -sum(p * math.log2(p) for p in share), move, sum(a == b for a, b in zip(value, value[1:], strict=False)) / n,
                self.coverage(value), float(bool(name)), self.odds["name"].get(name or "", 0.0),
                self.odds["before"].get(before or "", 0.0), self.odds["after"].get(after or "", 0.0),
                self.odds["path"].get(path or "", 0.0)]


def _featurer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for b in batches:
            names = ("path", "name", "value", "before", "after")
            rows = zip(*[b.column(c).to_pylist() for c in names], strict=True)
            values = pa.array([odds.features(*r) for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, values], names=[*b.schema.names, "features"])

    return run


def _with_features(found: DataFrame, odds) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    rows = found.mapInArrow(_featurer(odds), schema + ", features array<double>")
    return rows.withColumn("vector", array_to_vector("features"))


class Forest:
    """A trained forest with the odds its features need."""

    def __init__(self, odds, model: RandomForestClassificationModel | None):
        self.odds, self.model = odds, model

    def judge(self, found: DataFrame, min_score: float = 0.5) -> DataFrame:
        """Candidates with ``score`` and ``is_secret``."""
        if self.model is None:
            return found.withColumn("score", F.lit(0.5)).withColumn("is_secret", F.lit(True))
        rows = self.model.transform(_with_features(found, self.odds))
        rows = rows.withColumn("score", vector_to_array("probability")[1])
        return rows.select(*found.columns, "score", (F.col("score") >= min_score).alias("is_secret"))


def fit(labelled: DataFrame, dictionary: tuple[str, ...] = DICTIONARY, sample: int = SAMPLE, seed: int = 3) -> Forest:
    """Train on labelled findings (candidates with ``label`` 0 or 1), about ``sample`` of each."""
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("label").isin(0, 1)).withColumn("label", F.col("label").cast("int"))
    n = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return Forest(None, None)
    pick = F.pmod(F.xxhash64("doc_id", "at", "value"), F.when(F.col("label") == 1, n[1]).otherwise(n[0])) < sample
    some = labelled.where(pick)
    odds = spark.sparkContext.broadcast(Odds(some.select("path", "name", "value", "before", "after", "label").collect(), dictionary))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return Forest(odds, forest.fit(_with_features(some, odds).select("vector", "label")))


def scan(docs: DataFrame, path: str = "source", labels: Column | None = None) -> DataFrame:
    """Candidates of all documents, each judged by a forest trained on the labelled ones."""
    found = land(candidates(docs, path), "secret-candidates")
    forest = fit(found.withColumn("label", rule_labels() if labels is None else labels))
    return forest.judge(found)
