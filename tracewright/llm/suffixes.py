"""Suffixes of word sequences in order, with the lengths of their common prefixes, in numpy.

Many sequences are sorted at once; suffixes meet only within one group (one text, or one group of passages). The order of words is
that of their hashes: any fixed order gives the same tree. Only suffixes that share ``least`` words with another one of their group are
sorted, since all others are leaves right below the root.
"""

from __future__ import annotations

import numpy as np

from tracewright.llm.words import U, grams, mix


def repeated(words: np.ndarray, end: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """Positions whose next ``least`` words start at two positions or more of their group."""
    starts = np.flatnonzero(np.arange(len(words)) + least <= end)
    if len(starts) < 2:
        return starts[:0]
    keys = mix(grams(words, least)[starts] ^ mix(group[starts].astype(U) + U(1)))
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    return starts[np.isin(keys, twice)] if len(twice) else starts[:0]


def _bordered(keys: list[np.ndarray]) -> np.ndarray:
    """True where any of the sorted keys changes; True at first."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _group_starts(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_order(words: np.ndarray, end: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, words shared with the one before).

    ``end`` is where the sequence of each position ends, ``group`` its group. Ranks of the first ``least`` words come from a sort; each round
    doubles their reach by the rank of what follows, for the suffixes that still tie.
    """
    start = repeated(words, end, group, least)
    if not len(start):
        return start, start
    after = start + least
    at = np.union1d(start, after[after < end[start]])  # what follows must be in word order too
    index = np.full(len(words), -1, np.int32)
    index[at] = np.arange(len(at), dtype=np.int32)
    last = end[at]
    keys = [group[at]]
    for k in range(least):
        there = at + k
        keys.append(np.where(there < last, words[np.minimum(there, len(words) - 1)] | U(1), U(0)))
    order = np.lexsort(keys[::-1])
    rank = np.empty(len(at), np.int32)
    rank[order] = _group_starts(_bordered([k[order] for k in keys]))
    levels, reach = [rank], least
    while True:
        rank = levels[-1]
        tied = np.flatnonzero(np.bincount(rank, minlength=len(at))[rank] > 1)
        if not len(tied):
            break
        there = at[tied] + reach
        inside = there < last[tied]
        second = len(at) + tied  # a sequence that ended is like no other
        second[inside] = rank[index[there[inside]]]
        order = np.lexsort((second, rank[tied]))
        old, second = rank[tied][order], second[order]
        first = _bordered([old])
        rank = rank.copy()
        rank[tied[order]] = old + _group_starts(first | _bordered([second])) - _group_starts(first)
        levels.append(rank)
        reach *= 2
    order = np.argsort(levels[-1])
    return at[order], _common(words, end, group, at[order], index, levels, least)


def _common(words, end, group, order: np.ndarray, index: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Shared words of neighbours in the order, block by block from the longest rank down, then word by word."""
    a, b = order[:-1], order[1:]
    room = np.where(group[a] == group[b], np.minimum(end[a] - a, end[b] - b), 0)
    shared = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        go = np.flatnonzero(shared < room)
        left, right = index[(a + shared)[go]], index[(b + shared)[go]]
        same = (left >= 0) & (right >= 0) & (levels[level][left] == levels[level][right])
        shared[go[same]] += least << level
    go = np.flatnonzero(shared < room)
    for _ in range(least - 1):
        go = go[words[(a + shared)[go]] == words[(b + shared)[go]]]
        shared[go] += 1
        go = go[(shared < room)[go]]
    return np.concatenate(([0], np.minimum(shared, room)))
