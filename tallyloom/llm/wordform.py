"""Word extraction shared by the text operators.

A *word* is a maximal run of letters and digits (categories L and N) of the text after marks (M) and format characters
(Cf) are removed and the rest is lower-cased.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")


def _is_mark() -> np.ndarray:
    """For each code point, whether it is a mark (M) or a format character (Cf)."""
    kinds = (unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1))
    return np.fromiter((k[0] == "M" or k == "Cf" for k in kinds), dtype=bool, count=sys.maxunicode + 1)


_MARK = _is_mark()


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def strip_marks(text: str) -> str:
    if text.isascii():
        return text
    code = _code_points(text)
    mark = _MARK[code]
    return code[~mark].tobytes().decode("utf-32-le", "surrogatepass") if mark.any() else text


def words(text: str | None) -> list[str]:
    """The words of a text; a null text has none."""
    return _WORD.findall(strip_marks(text).lower()) if text else []


def words_with_spans(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """Words and, for each, its [start, end) in the original text."""
    if not text:
        return [], []
    place = None
    plain = strip_marks(text)
    if len(plain) != len(text):
        place = np.flatnonzero(~_MARK[_code_points(text)]).tolist()
    low = plain.lower()
    if len(low) != len(plain):  # a letter whose lower case is longer
        back: list[int] = []
        for i, c in enumerate(plain):
            back.extend([i] * len(c.lower()))
        low = "".join(c.lower() for c in plain)
        place = [place[i] for i in back] if place is not None else back
    found, spans = [], []
    for m in _WORD.finditer(low):
        found.append(m.group())
        a, b = m.start(), m.end() - 1
        spans.append((place[a], place[b] + 1) if place is not None else (a, b + 1))
    return found, spans


class WordHasher:
    """64-bit hashes of words, and of runs of words; the cache is bounded."""

    def __init__(self, limit: int = 400_000):
        self.cache: dict[str, int] = {}
        self.limit = limit

    def __call__(self, found: list[str]) -> np.ndarray:
        get, cache = self.cache.get, self.cache
        out = [get(w) for w in found]
        if None in out:
            if len(cache) > self.limit:
                cache.clear()
            for i, h in enumerate(out):
                if h is None:
                    out[i] = cache[found[i]] = xxhash.xxh3_64_intdigest(found[i])
        return np.array(out, dtype=np.uint64)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct 32-bit hashes (as int32, sorted) of the runs of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.int32)
    end = len(hashes) - n + 1
    h = hashes[:end].copy()
    for i in range(1, n):
        h = (h * _M1 + _M2) ^ hashes[i : end + i]
    return np.unique((mix(h) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a word sequence."""
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), dtype=np.uint64).view(np.int64))
