"""Sentence boundaries across languages and scripts by a pushdown automaton.

A text is cut into blocks at blank lines and around list items.  Within a block an automaton
reads its events (end marks, opening and closing signs, spaces between Thai letters); the stack
holds the quotations and brackets that are open.  Abbreviations are recognised by a trie read
backwards from the full stop.  Every text takes one pass over the characters in compiled patterns
and one step per event.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: abbreviations by what may follow them ------------------------------------
#: never end a sentence
_NEVER = """
dr prof col st mr mrs ms gen capt lt sgt rev hon gov sen rep messrs sr sra srta dra dña fr frau hr ing dipl mme mlle
mm проф акад им ул пр пл напр см ср тыс млн डॉ श्री सं
cf vgl viz approx ca circa aprox env prox прибл ок e.g i.e eg ie vs a.k.a bzw ggf gem evtl sog inkl zzgl u.a.m mt ee
"""
_NEVER_PHRASES = "z. b|d. h|u. a|i. d. r|s. o|s. u|p. ej|p. ex|c.-à-d|т. е|т. к|т. н|q. v"
#: go before numbers; end a sentence before anything else in upper case
_BEFORE_NUMBERS = """
no nos nr núm num n.º fig figs eq eqs sect sec ch chap vol vols pp pg pág págs art arts abb abs kap bd ed eds éd aufl
par para app tab tbl ref refs item рис табл стр гл кв
jan feb mar apr jun jul aug sep sept oct nov dec febr mär okt dez janv févr juil ene abr ago dic янв февр апр авг сент окт нояб дек
"""
#: may end a sentence: they do before a new start if enough of a sentence stands before them
_FINAL = """
etc usw u.s u.k u.n e.u u.s.a ph.d m.d b.a m.a b.sc m.sc inc ltd co corp bros jr llc plc gmbh s.a a.m p.m a.d b.c
al uu u.s.w bv dept univ assn
"""
_FINAL_PHRASES = "et al|ee. uu|a. m|p. m|u. s|т. д|т. п|и др|u. s. w|и пр"
#: words before a single letter that is a name of its own ("plan B")
_LABELS = frozenset("plan vitamin type grade class option team group hepatitis exhibit appendix section schedule version variant line model series block unit phase".split())
_SAID = frozenset("said says answered replied".split())
_GERMAN_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

NEVER, BEFORE_NUMBERS, FINAL = 1, 2, 3

# --- fixed values: signs -----------------------------------------------------------------------
_PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "〔": "〕", "‘": "’", "‚": "‘", '"': '"', "'": "'"}
_BRACKETS = frozenset("（([【〔")
_ENDS = ".!?…。！？．।|؟۔｡"
_CLOSING = "".join(dict.fromkeys("".join(_PAIRS.values()).replace("‘", "").replace("“", "")))
_GOES_ON = frozenset(",;:–—-、，：；،؛/")
_INTRODUCES = frozenset(":,：，،、")

_EVENT = re.compile(
    rf"[{re.escape(_ENDS)}]+|[{re.escape(''.join(dict.fromkeys([*_PAIRS, *_PAIRS.values()])))}]"
    r"|(?<=[ก-ฺเ-ๅ็-๎])[^\S\r\n]+(?=[ก-ฮเ-ไ])"
)
_BLANK = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:(?:\r\n|\n|\r)[^\S\r\n]*)+")
_LINE = re.compile(r"\r\n|\n|\r")
_ITEM = re.compile(r"[^\S\r\n]*(?:[-*•‣▪·–](?=[^\S\r\n])|(\d{1,3})[.)](?=[^\S\r\n])|[(]?[a-zA-Z][)](?=[^\S\r\n]))[^\S\r\n]*")
_SPACE = re.compile(r"\s*")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_LETTER_RUN = re.compile(r"\w+")
_BACK_CLOSERS = frozenset(_CLOSING + "“‘")


class Trie:
    """Abbreviations, read backwards from the full stop; a blank stands for any white space."""

    def __init__(self) -> None:
        self.root: dict = {}
        groups = (NEVER, _NEVER, _NEVER_PHRASES), (BEFORE_NUMBERS, _BEFORE_NUMBERS, ""), (FINAL, _FINAL, _FINAL_PHRASES)
        for kind, words, phrases in groups:
            for word in words.split() + [p for p in phrases.split("|") if p]:
                node = self.root
                for ch in reversed(word):
                    node = node.setdefault(ch, {})
                node[""] = kind

    def kind(self, text: str, start: int, stop: int) -> tuple[int, int]:
        """(kind, start) of the longest abbreviation that ends right before ``stop``."""
        node, at, found = self.root, stop - 1, (0, stop)
        while at >= start:
            ch = text[at]
            node = node.get(ch.lower() if len(ch.lower()) == 1 else ch) or node.get(" " if ch.isspace() else "\0")
            if node is None:
                break
            if "" in node and (at == start or not (text[at - 1].isalnum() or text[at - 1] in "_.")):
                found = node[""], at
            at -= 1
        return found


_TRIE = Trie()


def _pairs(text: str, events: list[re.Match]) -> tuple[dict[int, str], set[int]]:
    """Positions of the opening signs that are closed (with their sign), and of their closings."""
    stack: list[tuple[str, int, str]] = []  # what closes it, position, sign
    depths: dict[str, list[int]] = {}  # where the stack waits for a closing sign
    opened: dict[int, str] = {}
    closed: set[int] = set()
    size = len(text)
    for event in events:
        sign, at = event[0], event.start()
        if sign not in _PAIRS and sign not in _CLOSING and sign not in "“‘":
            continue
        before = text[at - 1] if at else " "
        after = text[at + 1] if at + 1 < size else " "
        if sign in "'’" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        depth = depths[sign][-1] if depths.get(sign) else -1
        if depth >= 0 and not (sign in "\"'" and (before.isspace() or (sign == "'" and after.isalnum()))):
            _, where, what = stack[depth]
            opened[where] = what
            closed.add(at)
            for close, _, _ in stack[depth:]:
                depths[close].pop()
            del stack[depth:]
        elif sign in _PAIRS:
            if sign in "\"'" and not (before.isspace() or before in _PAIRS or before in _GOES_ON or before in _ENDS):
                continue
            if sign in "\"'" and after.isspace():
                continue
            depths.setdefault(_PAIRS[sign], []).append(len(stack))
            stack.append((_PAIRS[sign], at, sign))
    return opened, closed


def _caseless(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper()


def _words_before(text: str, start: int, stop: int) -> int:
    return len(text[start:stop].split(None, 5))


class Block:
    """The automaton over one block ``text[start:stop]``; ``first`` is where its text begins,
    after a list marker."""

    def __init__(self, text: str, start: int, first: int, stop: int) -> None:
        self.text, self.start, self.first, self.stop = text, start, first, stop

    def units(self) -> Iterator[tuple[int, int]]:
        text, stop = self.text, self.stop
        events = list(_EVENT.finditer(text, self.first, stop))
        opened: dict[int, str] = {}
        closed: set[int] = set()
        if any(e[0][0] not in _ENDS for e in events):
            opened, closed = _pairs(text, events)
        self.opened = opened
        stack: list[tuple[str, str]] = []
        unit, begin, skip = self.start, self.first, 0
        for event in events:
            at, after = event.start(), event.end()
            if at < skip:
                continue
            sign = event[0]
            end = -1
            if at in opened:
                stack.append((sign, self._introduced(begin, at)))
            elif at in closed:
                sign, how = stack.pop()
                if not stack and self._marked(begin, at):
                    end = self._closing_end(after, sign, how)
            elif stack:
                continue
            elif sign[0] in _ENDS:
                end = self._mark_end(begin, at, after, sign)
            elif sign[0].isspace():
                end = at
            if end >= 0:
                yield unit, end
                skip = end
                unit = begin = _SPACE.match(text, end, stop).end()
        if unit < stop:
            yield unit, stop

    # -- what stands around ------------------------------------------------------------------

    def _introduced(self, begin: int, at: int) -> str:
        before = self.text[begin:at].rstrip()
        if not before or all(c in _PAIRS for c in before):
            return "start"
        return "announced" if before[-1] in _INTRODUCES else "mid"

    def _marked(self, begin: int, at: int) -> bool:
        """An end mark stands right before the closing sign, other closing signs aside."""
        at -= 1
        while at > begin and (self.text[at].isspace() or self.text[at] in _BACK_CLOSERS):
            at -= 1
        return at >= begin and self.text[at] in _ENDS

    def _closers(self, at: int) -> int:
        while at < self.stop and self.text[at] in _CLOSING and at not in self.opened:
            at += 1
        return at

    def _next(self, at: int) -> str:
        at = _SPACE.match(self.text, at, self.stop).end()
        return self.text[at] if at < self.stop else ""

    # -- does the unit end? ------------------------------------------------------------------

    def _closing_end(self, after: int, sign: str, how: str) -> int:
        """A mark stood right before this closing sign: the position if the unit ends here."""
        nxt = self._next(after)
        if not nxt:
            return after
        if nxt in _GOES_ON or nxt in _ENDS or nxt in _CLOSING and nxt not in _PAIRS:
            return -1
        if nxt.islower():
            return -1
        if _caseless(nxt):
            ends = how == "announced" or (how == "start" and sign in _BRACKETS)
            return after if ends else -1
        if sign in _BRACKETS and how == "mid":
            return after if nxt.isupper() else -1
        return after

    def _mark_end(self, begin: int, at: int, after: int, sign: str) -> int:
        text, stop = self.text, self.stop
        if at == begin and sign[0] == "." and after < stop and text[after].isalnum():
            return -1  # ".5"
        end = self._closers(after)
        if end >= stop:
            return stop
        nxt = text[end]
        spaced = nxt.isspace()
        if sign == ".":
            return end if self._stop_ends(begin, at, end, nxt, spaced) else -1
        if sign == "|":
            return end if at > begin and self._devanagari_before(begin, at) else -1
        if not sign.strip(".…"):
            follower = self._next(end)
            if not follower:
                return stop
            if follower in _GOES_ON or follower.islower() or (not spaced and (_caseless(follower) or follower.isdigit())):
                return -1
            return end
        if sign == "．" and nxt.isdigit() and at > begin and text[at - 1].isdigit():
            return -1
        if sign[-1] in "?!" and not spaced and (nxt.islower() or nxt.isdigit() or nxt in "=&/") and text[at - 1].isascii():
            return -1  # part of an address
        if nxt in _GOES_ON:
            return -1
        return end

    def _devanagari_before(self, begin: int, at: int) -> bool:
        before = self.text[max(begin, at - 3) : at].rstrip()
        return bool(before) and bool(_DEVANAGARI.match(before[-1]))

    def _stop_ends(self, begin: int, at: int, end: int, nxt: str, spaced: bool) -> bool:
        text = self.text
        if at == begin:
            return False
        last = text[at - 1]
        if not spaced and nxt in _GOES_ON or nxt in _ENDS:
            return False
        kind, where = _TRIE.kind(text, begin, at)
        if not spaced:
            if nxt.isdigit():
                return False
            if nxt.islower() or nxt == "_":
                return False
            if nxt.isupper():
                single = at - 2 < begin or not text[at - 2].isalpha()
                further = text.find(".", end, min(self.stop, end + 6))
                if further > 0 and _TRIE.kind(text, begin, further)[1] < at:
                    return False  # inside "Ph.D."
                return not kind and not single and (last.islower() or last.isdigit() or _caseless(last))
            if _caseless(nxt):
                return not kind and _caseless(last) and at - 2 >= begin and not text[at - 2].isspace()
            return not kind
        follower = self._next(end)
        if follower in _GOES_ON and follower not in "-–—":
            return False
        low = follower.islower()
        if kind == NEVER:
            return False
        if kind == FINAL:
            return not low and _words_before(text, begin, at) > 3
        if kind == BEFORE_NUMBERS:
            if text[where:at].lower() == "no" and text[where].islower():
                return not low and (not follower.isdigit() or self._word_before(begin, where) in _SAID)
            return not low and not follower.isdigit()
        token = at - 1
        while token >= begin and (text[token].isalnum() or _DEVANAGARI.match(text[token])):
            token -= 1
        token += 1
        word = text[token:at]
        if len(word) == 1 and word.isalpha():
            return self._letter_ends(begin, token, at, low, follower)
        if word.isdigit():
            if low:
                return False
            return not (len(word) <= 2 and self._word_after(end).lower() in _GERMAN_MONTHS)
        if len(word) <= 3 and _DEVANAGARI.match(last):
            return False
        return True

    def _letter_ends(self, begin: int, where: int, at: int, low: bool, follower: str) -> bool:
        """A full stop after a single letter: an initial, unless the letter is a label."""
        letter = self.text[where]
        if low or follower.isdigit() and not letter.isupper():
            return False
        if letter == "г":
            return self.text[begin:where].rstrip()[-1:].isdigit() and follower.isupper()
        return letter.isupper() and self._word_before(begin, where) in _LABELS

    def _word_before(self, begin: int, at: int) -> str:
        words = self.text[max(begin, at - 40) : at].split()
        return words[-1].lower() if words else ""

    def _word_after(self, at: int) -> str:
        found = _LETTER_RUN.search(self.text, at, min(self.stop, at + 30))
        return found[0] if found else ""


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, start of the text after a list marker, stop) of every block."""
    start, size = 0, len(text)
    cuts = [(m.start(), m.end()) for m in _BLANK.finditer(text)] if "\n" in text or "\r" in text else []
    for a, b in [*cuts, (size, size)]:
        if start < a:
            yield from _lines(text, start, a)
        start = b


def _lines(text: str, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    breaks = [(m.start(), m.end()) for m in _LINE.finditer(text, start, stop)]
    begin, first, in_item, number = start, start, False, None
    lines = zip([start, *(b for _, b in breaks)], [*(a for a, _ in breaks), stop], strict=True)
    for k, (a, b) in enumerate(lines):
        item = _ITEM.match(text, a, b)
        if item and item.end() >= b:
            item = None
        if item and item[1] and k and not (int(item[1]) == 1 or (in_item and number is not None and int(item[1]) == number + 1)):
            item = None
        if k and (item or in_item):
            if begin < a:
                yield from _trim(text, begin, first, a)
            begin = first = a
        if item:
            first = item.end()
            number = int(item[1]) if item[1] else None
        in_item = bool(item)
    yield from _trim(text, begin, first, stop)


def _trim(text: str, start: int, first: int, stop: int) -> Iterator[tuple[int, int, int]]:
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    start = _SPACE.match(text, start, stop).end()
    if start < stop:
        yield start, max(start, min(first, stop)), stop


def split_sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the units of a text in order, in code points, without white space at the edges."""
    units: list[tuple[int, int]] = []
    for start, first, stop in _blocks(text):
        own = len(units)
        for a, b in Block(text, start, first, stop).units():
            while b > a and text[b - 1].isspace():
                b -= 1
            if b <= a:
                continue
            if len(units) > own and not any(c.isalnum() for c in text[a:b]):
                units[-1] = (units[-1][0], b)  # stray marks belong to the unit before
            else:
                units.append((a, b))
    return units


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit_no, start_pos, end_pos) of every sentence unit of every text, in order.

    Positions count code points from 0, end exclusive.  Null, empty and blank texts have no
    units.  Rows with a null id keep it; repeated rows repeat their units.  An empty table gives
    no rows; other columns are ignored.  Texts are read whole, one at a time; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, flat = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = split_sentences(text) if text else []
                if found:
                    ids.append(i)
                    counts.append(len(found))
                    flat.extend(found)
            if flat:
                at = np.repeat(np.arange(len(ids)), counts)
                spans = np.array(flat, dtype=np.int64)
                numbers = np.arange(len(spans)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(pa.array(at)), pa.array(numbers.astype(np.int32)), pa.array(spans[:, 0]), pa.array(spans[:, 1])],
                    names=["id", "unit_no", "start_pos", "end_pos"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, unit_no int, start_pos bigint, end_pos bigint")
