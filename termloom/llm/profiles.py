"""Per-row text profiles: form fingerprints and shingle sets, computed once per text.

``form`` columns (l1, l2) fingerprint the letters and digits of the folded text; ``field``
columns (m1, m2) are a commutative multiset hash over (field name, value) pairs, null unless the
text is made of two or more labelled fields; (s1, s2) fingerprint the shingle set.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from termloom.llm import textform as tf

# fixed values of the field syntax: names, then ':' or '=', at the start or after '|', ';' or a line end
_LABEL = re.compile(r"(?:\A|[|;\n\r\x0b\x0c\x85  ])\s*(title|topic|summary|body)\s*[:=]")

_MASK = (1 << 64) - 1
#: set fingerprints a task remembers to write each set's features once
REMEMBERED_SETS = 1_000_000


def signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _letters(words: list[str]) -> bytes:
    return "".join(words).encode("utf-8", "surrogatepass")


def labelled_fields(folded: str) -> list[tuple[str, bytes]] | None:
    """(name, letters and digits of the value) of a text made of two or more labelled fields."""
    if not _LABEL.match(folded):
        return None
    found = list(_LABEL.finditer(folded))
    if len(found) < 2:
        return None
    ends = [m.start() for m in found[1:]] + [len(folded)]
    return [(m[1], _letters(tf.words_of(folded[m.end() : end]))) for m, end in zip(found, ends, strict=True)]


def multiset_hash(pairs: list[tuple[str, bytes]]) -> tuple[int, int]:
    """Sum of the pairs' hashes: the same for every order of the pairs, nothing is sorted."""
    low = high = 0
    for name, value in pairs:
        h = xxhash.xxh3_128_intdigest(name.encode() + b"\0" + value)
        low += h
        high += h >> 64
    return signed(low), signed(high)


def form_of(text: str | None) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """Form and field fingerprints of one text; none without a letter or digit."""
    folded = tf.fold(text or "")
    _, counts, letters = tf.scan([folded])
    if not counts[0]:
        return None, None
    fields = labelled_fields(folded)
    return tuple(letters[0].tolist()), multiset_hash(fields) if fields else None


def same_in_form(a: str | None, b: str | None) -> bool:
    """Exact test behind equal fingerprints: same letters, or the same multiset of fields."""
    fa, fb = tf.fold(a or ""), tf.fold(b or "")
    la, lb = _letters(tf.words_of(fa)), _letters(tf.words_of(fb))
    if la == lb:
        return bool(la)
    pa_, pb = labelled_fields(fa), labelled_fields(fb)
    return bool(la and lb and pa_ and pb) and Counter(pa_) == Counter(pb)


def key_of(doc_id: str | None) -> tuple[int, int] | None:
    """Fingerprint of an identifier apart from letter case and blanks at its edges."""
    return None if doc_id is None else tuple(tf.digests([_key(doc_id)])[0].tolist())


def _key(doc_id: str) -> bytes:
    return doc_id.strip(" \t\r\n").lower().encode("utf-8", "surrogatepass")


def _pairs(values: np.ndarray, missing: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(values[:, c]), mask=missing) for c in range(2)]


def _fields(folded: list[str], wordless: np.ndarray) -> list[pa.Array]:
    """The two columns of the multiset hashes."""
    found = [multiset_hash(f) if (f := labelled_fields(t)) else (None, None) for t in folded]
    out = [pa.array([f[c] for f in found], pa.int64()) for c in range(2)]
    return [pc.if_else(pa.array(wordless), pa.scalar(None, pa.int64()), x) for x in out]


def _folded_groups(ids: list, texts: list) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, folded texts) in groups; rows without an id are left out."""
    rows = [n for n, i in enumerate(ids) if i is not None]
    held = [texts[n] or "" for n in rows]
    for a, b in tf.groups(held):
        yield rows[a:b], [tf.fold(t) for t in held[a:b]]


FORM_SCHEMA = "id bigint, l1 bigint, l2 bigint, m1 bigint, m2 bigint"


def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> form fingerprints; texts without letters or digits are dropped."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for rows, folded in _folded_groups(ids, batch.column(1).to_pylist()):
            _, counts, letters = tf.scan(folded)
            wordless = counts == 0
            columns = [pa.array([ids[n] for n in rows], pa.int64()), *_pairs(letters, wordless), *_fields(folded, wordless)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "l1", "l2", "m1", "m2"]).filter(pa.array(~wordless))


PROFILE_SCHEMA = "id bigint, k1 bigint, k2 bigint, l1 bigint, l2 bigint, m1 bigint, m2 bigint, s1 bigint, s2 bigint, size int, features binary"
_PROFILE_NAMES = [c.split()[0] for c in PROFILE_SCHEMA.split(", ")]


def profiler(shingle: int):
    """(id, doc_id, text) -> profiles.

    ``features`` holds the sorted 64-bit shingle hashes; a task writes them once per distinct set,
    so exact copies cost a light row only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, folded in _folded_groups(ids, batch.column(2).to_pylist()):
                hashes, counts, letters = tf.scan(folded)
                features, sizes = tf.shingle_sets(hashes, counts, shingle)
                stops = np.cumsum(sizes)
                data = [features[b - n : b].tobytes() for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                sets = tf.digests(data)
                held = []
                for s, content in zip(map(tuple, sets.tolist()), data, strict=True):
                    fresh = bool(content) and s not in known
                    if fresh:
                        if len(known) >= REMEMBERED_SETS:
                            known.clear()
                        known.add(s)
                    held.append(content if fresh else None)
                named = [keys[n] for n in rows]
                nameless, wordless = np.array([k is None for k in named]), counts == 0
                columns = [
                    pa.array([ids[n] for n in rows], pa.int64()),
                    *_pairs(tf.digests(_key(k or "") for k in named), nameless),
                    *_pairs(letters, wordless),
                    *_fields(folded, wordless),
                    *_pairs(sets, sizes == 0),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(held, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_PROFILE_NAMES)

    return run
