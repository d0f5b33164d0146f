"""Words, word runs and character runs of Arrow texts as 64-bit hashes, by numpy over the texts' bytes.

A word's hash is a polynomial in its bytes modulo 2^64, taken from running sums, then mixed; so no Python
object is made for a word. Texts are worked through in parts of bounded size, cut at white space; only a
single word longer than a part makes a part longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PART = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

#: Lower-cases A-Z, leaves all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words, where only ASCII white space parts words.
NO_SPACE = np.ones(256, bool)
NO_SPACE[[32, *range(9, 14)]] = False
#: Bytes of words, where all in ASCII but letters and digits parts words.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Runs of letters and digits, and runs of marks.
LETTERS_AND_MARKS = np.where(LETTERS, 1, np.where(NO_SPACE, 2, 0)).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each hash over all of its bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, PART) - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each starts and the last ends. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, content = texts.buffers()
    at = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of one part: the text that each is of, where each is in the part, and running sums to hash them."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Of the words, or of their first bytes, `most` at most."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return mix((self.sums[ends] - self.sums[self.starts]) * powers(len(self.sums))[1][self.starts] ^ (ends - self.starts).astype(np.uint64))


def parts(content: np.ndarray, at: np.ndarray, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about `most`, each ending at a text's end or after white space."""
    start, end = 0, int(at[-1])
    while start < end:
        stop = min(start + most, end)
        if stop < end:
            k = int(np.searchsorted(at, stop, "right")) - 1
            if at[k] > start:
                stop = int(at[k])
            else:  # within one text
                text_end = int(at[k + 1])
                look = stop
                while look < text_end and NO_SPACE[content[look]]:
                    look += 1
                stop = look + 1 if look < text_end else text_end
        yield start, stop
        start = stop


def words(texts: pa.Array, kinds: np.ndarray = NO_SPACE, lower: bool = True, most: int = PART) -> Iterator[Words]:
    """Words of all texts, part by part, in order. A text longer than a part goes on in the next.

    kinds: for each byte 0 between words, else the kind of word that it belongs to; a word is a run of one kind.
    """
    content, at = text_bytes(texts)
    kinds = kinds.astype(np.uint8)
    for start, stop in parts(content, at, most):
        raw = content[start:stop]
        kind = kinds[raw]
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        first, last = np.searchsorted(at, start, "right"), np.searchsorted(at, stop, "left")
        edge[at[first:last] - start] = True  # texts' ends within the part
        bounds = np.flatnonzero(edge)
        some = kind[bounds[:-1]] > 0
        s, e = bounds[:-1][some], bounds[1:][some]
        low = LOWER[raw] if lower else raw
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=sums[1:])
        yield Words(np.searchsorted(at, start + s, "right") - 1, s, e, sums)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs, in order."""
    return mix(first * np.uint64(0x9FB21C651E98DF25) + second)
