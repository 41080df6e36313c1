"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts whose words are hashed together, so that arrays stay in a processor's cache.
PIECE = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """Pseudorandom odd numbers by place; always the same ones."""
    return scrambled(np.arange(1, count + 1, dtype=np.uint64) * ODD + np.uint64(seed)) | np.uint64(1)


#: A random number for each byte, none for white space.
_BYTES = scrambled(np.arange(256, dtype=np.uint64) + np.uint64(77))
_BYTES[_SPACE] = 0
_BASE = int(odd_numbers(1, 1)[0])
_powers: list[np.ndarray] = []


def _powers_for(count: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    if not _powers or count > len(_powers[0]):
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            own = np.ones(1, np.uint64)
            while len(own) < count:
                own = np.concatenate((own, own * np.uint64(pow(base, len(own), 1 << 64))))
            found.append(own)
        _powers[:] = found
    return _powers


def _codes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of the words of lower-cased bytes, where they start, and their first two bytes and last."""
    byte = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff((~_SPACE)[byte].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return np.empty(0, np.uint64), start, np.empty(0, np.int32)
    powers, inverses = _powers_for(len(byte))
    sums = np.add.reduceat(_BYTES[byte] * powers[: len(byte)], start)
    last = start + size - 1
    shape = byte[start].astype(np.int32) | byte[np.minimum(start + 1, last)].astype(np.int32) << 8 | byte[last].astype(np.int32) << 16
    return scrambled(sums * inverses[start] + size.astype(np.uint64) * ODD), start, shape


def words_and_shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, one text after the other; the place of each
    text's first word (and, last, their number); and each word's first two bytes and last.

    Words are what stands between ASCII white space, A-Z lower-cased.  A
    code is a polynomial of random numbers by byte, mixed with the length.
    """
    raws = [t.encode().lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    raw = b"\n".join(raws)
    found, at = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))], 0
    while at < len(raw):  # pieces end at white space
        upto = at + PIECE
        upto = min((k for k in (raw.find(b" ", upto), raw.find(b"\n", upto)) if k >= 0), default=len(raw)) if upto < len(raw) else len(raw)
        codes, start, shape = _codes(raw[at:upto])
        found.append((codes, start + at, shape))
        at = upto
    codes, starts, shapes = map(np.concatenate, zip(*found))
    return codes, np.append(0, np.searchsorted(starts, ends)), shapes


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes and places of :func:`words_and_shapes`."""
    return words_and_shapes(texts)[:2]


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One code for each place of several arrays, by their order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for c in parts:
        out = (out ^ c) * ODD
        out ^= out >> np.uint64(29)
    return out


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0]..high[0]-1, low[1]..high[1]-1, and so on."""
    size = high - low
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(low - first, size)


class Places:
    """Finds the place of codes in a list of different ones.

    Codes are kept by their leading bits; of several with the same, all but
    one are kept in a smaller table by the bits that follow, and so on.
    """

    def __init__(self, codes: np.ndarray):
        self._codes, self._tables = codes, []
        left, skip = np.arange(len(codes)), 0
        while len(left):
            bits = max(4, int(4 * len(left)).bit_length())
            skip = skip if skip + bits <= 64 else 0
            slots = self._slots(codes[left], skip, bits)
            table = np.full(1 << bits, -1, np.int32)
            table[slots] = left
            self._tables.append((skip, bits, table))
            left, skip = left[table[slots] != left], skip + bits // 2

    @staticmethod
    def _slots(codes: np.ndarray, skip: int, bits: int) -> np.ndarray:
        return (codes << np.uint64(skip) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes, -1 for those that aren't in the list."""
        out = np.full(len(codes), -1, np.int64)
        open_ = None
        for skip, bits, table in self._tables:
            own = codes if open_ is None else codes[open_]
            at = table[self._slots(own, skip, bits)]
            hit = (at >= 0) & (self._codes[at] == own)
            rest = (at >= 0) & ~hit
            if open_ is None:
                out[hit] = at[hit]
                open_ = np.flatnonzero(rest)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[rest]
            if not len(open_):
                break
        return out
