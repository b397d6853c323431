"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text: str | None) -> list[str]:
    return SPACE_WORDS.findall(text or "")


def fingerprint(text: str | None, k: int = 4) -> int:
    w = words(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints: list[int], ids: list[int], max_bits: int) -> list[int]:
    """Smallest id reachable over prints at most max_bits apart."""
    best = dict(zip(range(len(ids)), ids, strict=True))
    near = [[j for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= max_bits] for i in range(len(ids))]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(best[j] for j in js)
            if m < best[i]:
                best[i] = m
                changed = True
    return [best[i] for i in range(len(ids))]


def substring_dedup(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple]:
    first: dict[tuple, int] = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def crc_mod(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n
