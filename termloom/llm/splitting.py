"""Splitting oversized texts at natural boundaries by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the end marks that make a natural place, with white space
END_MARKS = ".!?。！？।؟…"
_CLOSERS = "\"'”’»)]}」』】〉》）］"

PIECE_SCHEMA = "id bigint, piece_no int, start_pos int, end_pos int, grade int, forced boolean, piece string"


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(0x10000, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


_SPACE = np.array([chr(i).isspace() for i in range(0x10000)])
_MARK, _CLOSER = _flags(END_MARKS), _flags(_CLOSERS)
_BREAK = _flags("\n\r\x0b\x0c\x85  ")


def _is(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, 0xFFFF)] & (codes < 0xFFFF)


def boundaries(codes: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and their grades: 4 blank line, 3 sentence or line end, 2 white space,
    1 beside a mark, 0 forced inside a stretch without any natural place for over ``limit``
    characters.  The text's two ends are always boundaries."""
    n = len(codes)
    space, mark, line = _is(_SPACE, codes), _is(_MARK, codes), _is(_BREAK, codes)
    grade = np.full(n + 1, -1, dtype=np.int8)
    natural = space | mark
    grade[:n][natural] = 1  # before a mark or white space
    grade[1:][natural] = 1
    grade[1:][space] = 2
    # after white space: the last character in front of it, closing signs skipped, is an end mark
    solid = np.where(space | _is(_CLOSER, codes), -1, np.arange(n))
    last = np.maximum.accumulate(solid)
    ended = space & (last >= 0) & mark[np.maximum(last, 0)]
    grade[1:][ended] = 3
    # scripts without spaces: right after a full-width mark
    wide = mark & (codes >= 0x0964)
    follows_mark = np.zeros(n, dtype=bool)
    follows_mark[:-1] = mark[1:] | _is(_CLOSER, codes[1:])
    grade[1:][wide & ~follows_mark] = 3
    grade[1:][line] = 3
    lines = np.flatnonzero(line)
    if len(lines) > 1:
        # two line ends with only white space between them
        solids = np.concatenate([[0], np.cumsum(~space)])
        blank = (solids[lines[1:]] == solids[lines[:-1] + 1]) & ~((codes[lines[:-1]] == 13) & (codes[lines[1:]] == 10) & (lines[1:] == lines[:-1] + 1))
        grade[lines[1:][blank] + 1] = 4
    grade[0] = grade[n] = 4
    at = np.flatnonzero(grade >= 0)
    stride = max(1, limit - overlap)
    forced = [np.arange(at[g] + limit, at[g + 1], stride) for g in np.flatnonzero(np.diff(at) > limit)]
    if forced:
        grade[np.concatenate(forced)] = 0
        at = np.flatnonzero(grade >= 0)
    return at, grade[at]


def successors(at: np.ndarray, grade: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a piece that ends at each boundary, the start of the next piece and its farthest legal
    end, as indices into the table.

    The next piece starts at the first boundary within the overlap, later only where the next
    boundary would otherwise be out of reach.  Its end is the farthest boundary of the best grade
    in the second half of the allowed length, else the farthest natural one, else a forced one.
    """
    m = len(at)
    index = np.arange(m)
    following = np.minimum(index + 1, m - 1)
    start = np.searchsorted(at, np.maximum(at - overlap, at[following] - limit), "left")
    start = np.minimum(start, index)
    start[0] = 0
    reach = np.searchsorted(at, at[start] + limit, "right") - 1
    half = at[start] + limit // 2
    best = np.where(reach > index, reach, following)
    for g in (1, 2, 3, 4):  # a better grade replaces a worse one
        last = np.maximum.accumulate(np.where(grade >= g, index, -1))[reach]
        legal = (last > index) & ((at[np.maximum(last, 0)] >= half) | (g == 1))
        best = np.where(legal, last, best)
    best[m - 1] = m - 1
    best = np.where(reach == m - 1, m - 1, best)  # what is left fits
    return start, best


def reached(succ: np.ndarray) -> np.ndarray:
    """All boundaries on the way from the first one, by squaring the successor table: after i
    squarings the table leaps 2**i cuts, and every leap from a marked boundary marks another."""
    marked = np.zeros(len(succ), dtype=bool)
    marked[0] = True
    leap, count = succ, 1
    while True:
        marked[leap[marked]] = True
        now = int(marked.sum())
        squared = leap[leap]
        if now == count and np.array_equal(squared, leap):
            return marked
        leap, count = squared, now


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, grade of the end, forced) of the consecutive pieces of one text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) <= limit:
        return [(0, len(codes), 4, False)]
    at, grade = boundaries(codes, limit, overlap)
    start, succ = successors(at, grade, limit, overlap)
    ends = np.flatnonzero(reached(succ))[1:]
    befores = np.concatenate([[0], ends[:-1]])
    starts = at[start[befores]]
    return list(zip(starts.tolist(), at[ends].tolist(), grade[ends].tolist(), (grade[ends] == 0).tolist(), strict=True))


def split_oversized(docs: DataFrame, id_col: str = "ordinal", text_col: str = "text", *, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(id, piece_no, start_pos, end_pos, grade, forced, piece) of every text of more than
    ``limit`` characters (code points), positions from 0, end exclusive.

    Pieces are at most ``limit`` long and cover the text; consecutive ones overlap by up to
    ``overlap`` characters, from a natural place on, less where a natural cut is in reach only
    so.  A cut is ``forced`` exactly in stretches of more than ``limit`` characters without a
    natural place (white space or end mark).  A text is one cell, so its boundary table and the
    squared successor tables stay within its task and nothing is shuffled.

    Null, empty and short texts give no pieces; rows with a null id are left out; repeated rows
    give repeated pieces.  An empty table gives no rows; other columns are ignored.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("needs limit >= 1 and 0 <= overlap < limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("piece_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("grade", pa.int32()), ("forced", pa.bool_()), ("piece", pa.string())])
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                pieces = cut_text(text, limit, overlap)
                rows = [(i.as_py(), n, s, e, g, f, text[s:e]) for n, (s, e, g, f) in enumerate(pieces)]
                for k in range(0, len(rows), 4096):
                    columns = zip(*rows[k : k + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    long = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return long.where(F.col("id").isNotNull() & (F.char_length("text") > limit)).mapInArrow(run, PIECE_SCHEMA)


def forced_texts(pieces: DataFrame) -> DataFrame:
    """(id, forced): 1 for texts with a forced cut, else 0."""
    return pieces.groupBy("id").agg(F.max(F.col("forced").cast("int")).alias("forced"))
