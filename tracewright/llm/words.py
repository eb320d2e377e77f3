"""Words of whole texts as 64-bit hashes, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Its hash is a
polynomial of its bytes modulo 2^64, scrambled; any two different words agree with a chance of about 2^-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; the longest asked for up to 4 pieces is kept."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.full(max(n, 1), base & (2**64 - 1), U)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= 4 * _PIECE:
        _powers[base] = out
    return out[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and len + 1 offsets that say which words are whose."""
    n = len(data)
    hashes, owners = [], []
    begin = 0
    while begin < n:
        end = min(n, begin + _PIECE)
        if end < n:  # cut where no word is cut: at white space, or where a text begins
            gap = np.flatnonzero(~_IS_WORD[data[end : end + 4096]])
            after = offsets[np.searchsorted(offsets, end)]
            if len(gap):
                end = min(end + int(gap[0]), int(after))
            else:
                blank = np.flatnonzero(~_IS_WORD[data[end : int(after)]])
                end = end + int(blank[0]) if len(blank) else int(after)
        piece = data[begin:end]
        piece = _LOWER[piece] if lower else piece
        word = _IS_WORD[piece]
        edge = np.zeros(len(piece) + 1, bool)
        inner = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end, "right")] - begin
        edge[inner] = True
        edge[0] = edge[-1] = True
        before = np.empty(len(piece), bool)
        before[0] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        following = np.empty(len(piece), bool)
        following[-1] = False
        following[:-1] = word[1:]
        ends = np.flatnonzero(word & (~following | edge[1:])) + 1
        if len(starts):
            total = np.zeros(len(piece) + 1, U)
            np.cumsum((piece.astype(U) + U(1)) * powers(_BASE, len(piece)), out=total[1:])
            value = (total[ends] - total[starts]) * powers(_INVERSE, len(piece))[starts]
            hashes.append(mix(value + (ends - starts).astype(U)))
            owners.append(starts + begin)
        begin = end
    if not hashes:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(owners), offsets).astype(np.int64)


def grams(words: np.ndarray, size: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hashes of all runs of ``size`` words; the run at i starts at word i. Runs over borders of texts are included."""
    if len(words) < size:
        return np.zeros(0, U)
    out = np.zeros(len(words) - size + 1, U)
    for i in range(size):
        out = out * U(seed) + words[i : i + len(out)]
    return mix(out)
