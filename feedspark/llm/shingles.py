"""Vectorised word and shingle hashing of whole texts (numpy over the UTF-8 bytes of a batch)."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_INV = pow(_P, -1, 1 << 64)
#: Bytes that are hashed at a time; bounds the memory of one pass whatever the text lengths.
CHUNK_BYTES = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


class _Tables:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.p = _powers(_P, 1 << 16)
        self.q = _powers(_INV, 1 << 16)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.p):
            size = 1 << max(16, (n - 1).bit_length())
            self.p, self.q = _powers(_P, size), _powers(_INV, size)
        return self.p[:n], self.q[:n]


_TABLES = _Tables()
_CHARS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Word bytes of the benchmark contract: all but \x00-\x2F \x3A-\x60 \x7B-\x7F, after lower-casing.
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = True
_ALNUM[0x61:0x7B] = True
_ALNUM[0x80:] = True
_CHARS_LOWER = _CHARS[_LOWER]
IS_SPACE_WORD = ~_SPACE
IS_ALNUM_WORD = _ALNUM[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of ``data`` with A-Z lower-cased.

    ``word_byte`` says which of the 256 byte values belong to words. The text is
    taken in pieces cut at a non-word byte, so memory is bounded by the longest word.
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    hashes, starts, ends = [], [], []
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + CHUNK_BYTES)
        if to < n:
            size = CHUNK_BYTES
            while True:
                gap = np.flatnonzero(~word_byte[buf[at:to]])
                if len(gap):
                    to = at + int(gap[-1]) + 1
                    break
                if to == n:
                    break
                size *= 2
                to = min(n, at + size)
        piece = buf[at:to]
        inside = word_byte[piece]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            p, q = _TABLES.upto(len(piece))
            total = np.empty(len(piece) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(_CHARS_LOWER[piece] * p, out=total[1:])
            hashes.append(mix((total[e] - total[s]) * q[s]))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    if len(hashes) == 1:
        return hashes[0], starts[0], ends[0]
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; one of the whole sequence if it is shorter."""
    size = min(size, len(words))
    if not size:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9DDFEA08EB382D69) + words[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text (null: empty)."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words, _, _ = word_hashes(text.encode("utf-8", "surrogatepass"), IS_SPACE_WORD)
    return np.unique(window_hashes(words, size))
