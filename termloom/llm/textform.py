"""Text folding, words, forms and word shingles shared by the text operators.

Everything here is plain Python/NumPy that runs inside Arrow batches on the
executors.  Definitions (TESTDATA.md, "Shared terms"):

* folded text: NFKC, without format characters (category Cf), lower case;
* words: longest runs of letters and digits of the folded text;
* form: the letters and digits of the folded text in order, nothing else;
* shingles: the set of runs of ``n`` consecutive words, as 64-bit hashes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex
import xxhash

_FORMAT_CHARS = regex.compile(r"\p{Cf}+")
_WORD = re.compile(r"[^\W_]+")

# odd multiplier of the polynomial hashes over characters and words, and its inverse modulo 2**64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LENGTH = 0xC2B2AE3D27D4EB4F
_UP = _DOWN = np.empty(0, dtype=np.uint64)
_WORD_CHARS = np.array([chr(c).isalnum() for c in range(0x10000)])
#: characters that are looked at together
GROUP_CHARS = 1 << 18


def fold(text: str) -> str:
    """NFKC form without format characters, in lower case."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _FORMAT_CHARS.sub("", text).lower()


def words_of(folded: str) -> list[str]:
    return _WORD.findall(folded)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (uint64 arrays)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def digests(contents: Iterable[bytes]) -> np.ndarray:
    """128-bit fingerprints, one row of two signed integers each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, contents)), dtype=">i8").reshape(-1, 2).astype(np.int64)


def word_chars(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits."""
    found = _WORD_CHARS[np.minimum(codes, 0xFFFF)]
    beyond = np.flatnonzero(codes > 0xFFFF)
    if len(beyond):
        found[beyond] = [chr(c).isalnum() for c in codes[beyond].tolist()]
    return found


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, kept per process."""
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = (np.multiply.accumulate(np.array([1, *[m] * n], dtype=np.uint64)) for m in (_MULTIPLIER, _INVERSE))
    return _UP, _DOWN


def _word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words ``codes[start:end]``, all from one running sum."""
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + GROUP_CHARS, "right")))
        size = int(ends[to - 1]) - low
        up, down = _powers(size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(codes[low : low + size] * up[:size], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(_LENGTH))


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with about ``GROUP_CHARS`` characters; a longer text stands alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > GROUP_CHARS:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def scan(folded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word in order, words per text, fingerprint of each text's letters and digits).

    The texts are read as one array of code points, so the cost per word and per text is that of
    a few array operations.
    """
    codes = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = word_chars(codes)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))  # every text ends outside a word
    starts, ends = edges[::2], edges[1::2]
    stops = np.cumsum([len(t) + 1 for t in folded], dtype=np.int64)
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    letters, upto = codes[inside], np.cumsum(inside)[stops - 1] if folded else stops
    pieces = (letters[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)) if folded else ()
    return _word_hashes(codes, starts, ends), counts, digests(pieces)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text one after the other, how many each has)."""
    runs = np.maximum(counts - (n - 1), 0)
    total = len(hashes) - n + 1
    if total <= 0 or not runs.any():
        return np.empty(0, dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    acc = np.zeros(total, dtype=np.uint64)
    for i in range(n):
        acc = acc * np.uint64(_MULTIPLIER) + hashes[i : i + total]
    # runs start at all words of a text but its last n - 1
    stops = np.cumsum(runs)
    first_words = np.cumsum(counts) - counts
    at = np.arange(stops[-1]) + np.repeat(first_words - (stops - runs), runs)
    shingles = mix64(acc[at])
    for a, b in zip((stops - runs).tolist(), stops.tolist(), strict=True):
        shingles[a:b].sort()
    fresh = np.ones(len(shingles), dtype=bool)
    np.not_equal(shingles[1:], shingles[:-1], out=fresh[1:])
    fresh[(stops - runs)[runs > 0]] = True
    sizes = np.diff(np.concatenate([[0], np.cumsum(fresh)])[stops], prepend=0)
    return shingles[fresh], sizes


def shingle_set(folded: str, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a folded text."""
    hashes, counts, _ = scan([folded])
    return shingle_sets(hashes, counts, n)[0]
