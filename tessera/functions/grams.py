"""Sentences, words and n-grams of many texts at once, as numbers: what functions.text does by patterns, over arrays.

A batch of texts is one array of code points; each step of functions.text.CLEANING is a mask over it. An n-gram is known
by 96 bits of hash (it is a sequence of words, and no word has a space), its place and its length in bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow

from tessera.functions.text import ENDINGS, MIN_BYTES, STARTERS

#: Characters of a text that are held at least before they are counted.
PIECE = 1 << 19
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_TAG, _ESCAPE = re.compile("<[^>]*>"), re.compile("\\\\[^ –\n]+")

# Classes of code points: what is deleted at once, later, or kept.
_TOP = 0x2100
_LATER, _NOW, _DOT, _COLON, _SPACE, _LINE, _COMMA, _ASK, _ROUND, _WORD, _END = range(11)
_CLASS = np.zeros(_TOP, np.uint8)
_LETTER = np.zeros(_TOP, np.uint8)
for _c in "–{&}“”#%^+_=$’~‘/<>\"":
    _CLASS[ord(_c)] = _NOW
for _c, _k in ((".", _DOT), (":", _COLON), (";", _COLON), (" ", _SPACE), ("\n", _LINE), (",", _COMMA), ("?", _ASK), ("!", _ASK), ("(", _ROUND), (")", _ROUND)):
    _CLASS[ord(_c)] = _k
for _k, _c in enumerate("-abcdefghijklmnopqrstuvwxyzåøæ", 1):
    for _x in {_c, _c.upper()}:
        _CLASS[ord(_x)], _LETTER[ord(_x)] = _WORD, _k
_CLASS[_TOP - 1], _OTHER = _END, 1  # the end of a text; any other code point is one that is deleted later
_BYTES = np.array([0, *[1] * 27, 2, 2, 2], np.int64)
_UTF8 = np.array([[0, *b"-abcdefghijklmnopqrstuvwxyz", 0xC3, 0xC3, 0xC3], [0] * 28 + [0xA5, 0xB8, 0xA6]], np.uint8)
_NUMBERS = np.random.Generator(np.random.PCG64(20240117))
_TABLE = _NUMBERS.integers(0, 1 << 64, (2, 31), np.uint64)
_weights = _NUMBERS.integers(0, 1 << 64, (2, 1 << 10), np.uint64)


def _weight(n: int) -> np.ndarray:
    """A number for each place in a word, the same in every process."""
    global _weights
    while _weights.shape[1] < n:
        more = np.random.Generator(np.random.PCG64(_weights.shape[1])).integers(0, 1 << 64, _weights.shape, np.uint64)
        _weights = np.concatenate([_weights, more], axis=1)
    return _weights


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _bare(text: str) -> str:
    """Without tags and escapes. What has no end is no tag, so each search ends before the last one does."""
    text = text.replace("\U0010ffff", "\U0010fffe")  # which stands between texts
    if "<" in text:
        end = text.rfind(">") + 1
        text = _TAG.sub("", text[:end]) + text[end:]
    return _ESCAPE.sub(" ", text) if "\\" in text else text


def _broken(kind: np.ndarray) -> np.ndarray:
    """Places after which a colon stands: the ends of runs of pairs of a character, other than . , : and space, and a line's end."""
    out, free, size = [], 0, len(kind)
    able = ~np.isin(kind, (_DOT, _COMMA, _COLON, _SPACE, _END))
    for p in np.flatnonzero(kind == _LINE).tolist():
        if p > free and able[p - 1]:
            end = p + 1
            while end + 1 < size and able[end] and kind[end + 1] == _LINE:
                end += 2
            out.append(end - 1)
            free = end
    return np.array(out, np.int64)


class Words:
    """Of texts: doc and sentence (from 1) of each word, its place in the sentence (from 1), hashes, bytes; sentences of each text."""

    def __init__(self, texts: list[str | None]):
        joined = "\U0010ffff".join([*[_bare(t) if t else "" for t in texts], ""])
        u = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        u = np.where(u == 0x10FFFF, _TOP - 1, np.where(u >= _TOP - 1, _OTHER, u)).astype(np.uint16)
        u = u[_CLASS[u] != _NOW]
        kind = _CLASS[u]
        colon = kind == _COLON
        keep = ~colon
        keep[1:] |= colon[1:] & ~colon[:-1]
        keep[:1] = True
        kind = np.where(colon, np.uint8(_DOT), kind)[keep]
        u = u[keep]
        if (at := _broken(kind)).size:
            kind, u = np.insert(kind, at + 1, _COLON), np.insert(u, at + 1, ord(":"))
        kept = kind != _LATER
        kind, u = kind[kept], u[kept]
        ends = (kind == _DOT) | (kind == _ASK)
        cut = ends.copy()
        cut[:-1] &= ~ends[1:]
        over = kind == _END
        # Segments end with the last mark of a run, or with the text; those that hold more than spaces are sentences.
        mark = cut | over
        segment = np.cumsum(mark) - mark
        full = np.zeros(int(mark.sum()) + 1, bool)
        full[segment[~mark & (kind != _SPACE) & (kind != _LINE)]] = True
        self.segments = full[:-1]
        before = np.concatenate([[0], np.cumsum(full)])
        last = segment[over]
        upto = before[last + 1]
        self.sentences = np.diff(upto, prepend=0)
        first = np.concatenate([[0], upto[:-1]])
        doc = np.cumsum(over) - over
        inside = kind != _ROUND
        kind, u, segment, doc = kind[inside], u[inside], segment[inside], doc[inside]
        letter = kind == _WORD
        starts = letter.copy()
        starts[1:] &= ~letter[:-1]
        at = np.flatnonzero(starts)
        stops = letter.copy()
        stops[:-1] &= ~letter[1:]
        size = np.flatnonzero(stops) + 1 - at
        self.doc, self.sentence = doc[at], before[segment[at]] + 1 - first[doc[at]]
        self.code = code = _LETTER[u[letter]]
        self._finish(size, _BYTES[code], lambda k: _TABLE[k][code])

    def _finish(self, size: np.ndarray, wide: np.ndarray, number) -> None:
        """Of words of so many characters: hashes, bytes, places and whether they bind."""
        self.start, self.size = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size
        if not size.size:
            self.hash, self.bytes, self.place = np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.open = self.close = np.zeros(0, bool)
            return
        place = np.arange(len(wide)) - np.repeat(self.start, size)
        weight = _weight(int(size.max()) + 1)
        self.hash = np.stack([_mixed(np.add.reduceat(number(k) * weight[k][place], self.start) + weight[k][size]) for k in (0, 1)])
        self.bytes = np.add.reduceat(wide, self.start)
        new = np.ones(len(size), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.sentence[1:] != self.sentence[:-1])
        head = np.flatnonzero(new)
        self.place = np.arange(len(size)) - np.repeat(head, np.diff(head, append=len(size))) + 1
        single = self.bytes == 1
        self.open, self.close = single | np.isin(self.hash[0], _hashes(type(self), STARTERS)), single | np.isin(self.hash[0], _hashes(type(self), ENDINGS))

    def grams(self, levels, least: int = MIN_BYTES):
        """For each level: n, the indices of the last words of n-grams, their hashes (64 and 32 bits) and bytes."""
        h, size = self.hash, self.bytes
        for n in range(1, max(levels) + 1):
            if n > 1:
                h = np.stack([_mixed(np.concatenate([h[k][:1], h[k][:-1]]) * _STEPS[k] + self.hash[k]) for k in (0, 1)])
                size = np.concatenate([size[:1], size[:-1]]) + 1 + self.bytes
            if n in levels:
                fits = (self.place >= n) & (size >= least)
                if n > 1:
                    fits[n - 1 :] &= ~(self.open[: len(fits) - n + 1] | self.close[n - 1 :])
                at = np.flatnonzero(fits)
                yield n, at, h[0][at].view(np.int64), (h[1][at] >> np.uint64(32)).astype(np.uint32).view(np.int32), size[at]

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all words, a space after each, and where each word starts in them."""
        wide = _BYTES[self.code]
        at = np.cumsum(wide) - wide + np.repeat(np.arange(len(self.size)), self.size)
        out = np.full(int(wide.sum()) + len(self.size), ord(" "), np.uint8)
        out[at] = _UTF8[0][self.code]
        two = wide == 2
        out[at[two] + 1] = _UTF8[1][self.code[two]]
        return out, at[self.start] if len(at) else np.zeros(0, np.int64)


def slices(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> pyarrow.Array:
    """The strings of so many bytes from each start on."""
    ends = np.cumsum(size)
    picked = letters[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pyarrow.LargeStringArray.from_buffers(len(size), pyarrow.py_buffer(offsets), pyarrow.py_buffer(picked)).cast(pyarrow.string())


class SentenceCount:
    """The sentences of one text that comes in parts: held are a piece of it and what a tag that may yet end would leave out.

    The text is cut between a space and a letter, which no pattern of functions.text.CLEANING but that of tags spans.
    """

    def __init__(self):
        self.closed, self.open, self.held, self.limit, self.outside = 0, False, "", PIECE, None

    def add(self, part: str) -> None:
        while part:
            if self.outside is not None:  # within what is a tag if an end comes, and else plain text
                end = part.find(">")
                if end < 0:
                    return self._feed(part)
                (self.closed, self.open, self.held, self.limit), self.outside = self.outside, None
                part = part[end + 1 :]
                continue
            end = part.rfind(">") + 1
            part = _TAG.sub("", part[:end]) + part[end:]
            start = part.find("<", part.rfind(">") + 1)
            if start < 0:
                return self._feed(part)
            self._feed(part[:start])
            self.outside = (self.closed, self.open, self.held, self.limit)
            return self._feed(part[start:])

    def total(self) -> int:
        """With the empty one that stands first."""
        self._count(self.held)
        self.held = ""
        return self.closed + self.open + 1

    def _feed(self, part: str) -> None:
        self.held += part
        if len(self.held) < self.limit:
            return
        at = len(self.held) - 1
        while (at := self.held.rfind(" ", 0, at)) >= 0:
            following = self.held[at + 1]
            if following.isascii() and following.isalpha():
                self._count(self.held[: at + 1])
                self.held, self.limit = self.held[at + 1 :], PIECE
                return
        self.limit = 2 * len(self.held)

    def _count(self, piece: str) -> None:
        first, *more = Words([piece]).segments.tolist()
        if more:
            self.closed += (self.open or first) + sum(more[:-1])
            self.open = more[-1]
        else:
            self.open = self.open or first


class PlainWords(Words):
    """Of texts that are one sentence each and are not cleaned: what stands between , . ; : ! ? and spaces, as it is."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        u = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), size)
        letter = ~np.isin(u, [ord(c) for c in ",.;:!? "])
        edge = np.ones(len(u) + 1, bool)
        edge[1:-1] = doc[1:] != doc[:-1]
        starts = letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]]))
        stops = letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))
        at = np.flatnonzero(starts)
        self.sentences = np.ones(len(texts), np.int64)
        self.doc, self.sentence = doc[at], np.ones(len(at), np.int64)
        u = u[letter]
        wide = 1 + (u >= 0x80).astype(np.int64) + (u >= 0x800) + (u >= 0x10000)
        self._finish(np.flatnonzero(stops) + 1 - at, wide, lambda k: _mixed((u.astype(np.uint64) + np.uint64(1)) * _STEPS[k]))


_known: dict[tuple, np.ndarray] = {}


def _hashes(kind: type, words: tuple[str, ...]) -> np.ndarray:
    """First hashes of words; a cleaned text has none with an apostrophe."""
    if (kind, words) not in _known:
        _known[kind, words] = np.zeros(0, np.uint64)  # while the words themselves are read
        _known[kind, words] = np.concatenate([kind([w]).hash[0] for w in words if kind is PlainWords or "'" not in w])
    return _known[kind, words]
