"""Enhanced suffix arrays of many short symbol strings at once, and their LCP intervals."""

from __future__ import annotations

import numpy as np


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(keys)))


def suffix_order(symbols: np.ndarray, owner: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, their ranks, common prefixes with the place before) of all suffixes in order.

    ``owner`` numbers the strings, ``end`` is where a place's string ends. Suffixes are ordered
    by string first, so equal strings are not compared with each other; a suffix that is a
    prefix comes first. Prefix doubling, in which only suffixes that are not told apart yet
    are sorted on; the ranks of each round give the common prefixes afterwards.
    """
    n = len(symbols)
    if not n:
        return (np.empty(0, np.int64),) * 3
    key = owner * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    start, size = _runs(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    rounds = [rank.astype(np.int32)]
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    width = 1
    while len(open_):
        place = order[open_]
        ahead = place + width
        second = np.where(ahead < end[place], rank[np.minimum(ahead, n - 1)], -1)
        key = rank[place] * (n + 1) + second + 1
        turn = np.argsort(key, kind="stable")
        place = place[turn]
        order[open_] = place
        start, size = _runs(key[turn])
        rank[place] = np.repeat(open_[start], size)
        open_ = open_[np.repeat(size > 1, size)]
        width *= 2
        if len(open_):
            rounds.append(rank.astype(np.int32))
    return order, rank, _common_prefixes(order, rounds)


def _common_prefixes(order: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Two suffixes with equal ranks in round k agree in 2**k symbols."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    alike, pairs = [], np.arange(n - 1)
    for ranks in rounds:
        pairs = pairs[ranks[a[pairs]] == ranks[b[pairs]]]
        alike.append(pairs)
    for k in range(len(rounds) - 1, -1, -1):
        ranks = np.append(rounds[k], -1)  # the end of all strings
        pairs = alike[k]
        pairs = pairs[ranks[a[pairs]] == ranks[b[pairs]]]
        shared[pairs + 1] += 1 << k
        a[pairs] += 1 << k
        b[pairs] += 1 << k
    return shared


def intervals(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, first, last) of every LCP interval, and for each position the interval, or -1, that it parts."""
    depths, firsts, lasts, parted = [], [], [], []
    # What is open: depths, and numbers of intervals, with the root at the bottom.
    open_depth, open_number = [0], [-1]
    for at, depth in enumerate(shared.tolist()):
        first = at - 1
        while depth < open_depth[-1]:
            number = open_number.pop()
            open_depth.pop()
            lasts[number] = at - 1
            first = firsts[number]
        if depth > open_depth[-1]:
            open_depth.append(depth)
            open_number.append(len(depths))
            depths.append(depth)
            firsts.append(first)
            lasts.append(-1)
        parted.append(open_number[-1])
    for number in open_number[1:]:
        lasts[number] = len(shared) - 1
    return tuple(np.array(values, np.int64) for values in (depths, firsts, lasts, parted))


def smaller_children(
    first: np.ndarray, last: np.ndarray, parted: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(interval, position) for all positions in children of the wanted intervals but their largest one.

    A suffix is in a smaller child at most log2(n) times, so these are n log n rows at most.
    """
    cut = np.flatnonzero(parted >= 0)
    cut = cut[wanted[parted[cut]]]
    cut = cut[np.argsort(parted[cut], kind="stable")]
    chosen = np.flatnonzero(wanted)
    # A child starts where its interval does and at every position that parts it.
    owner = np.concatenate((chosen, parted[cut]))
    begin = np.concatenate((first[chosen], cut))
    turn = np.lexsort((begin, owner))
    owner, begin = owner[turn], begin[turn]
    next_begin = np.append(begin[1:], 0)
    final = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.empty(0, bool)
    size = np.where(final, last[owner] + 1, next_begin) - begin
    turn = np.lexsort((size, owner))
    owner, begin, size = owner[turn], begin[turn], size[turn]
    small = ~(np.append(owner[1:] != owner[:-1], True) if len(owner) else np.empty(0, bool))
    owner, begin, size = owner[small], begin[small], size[small]
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(owner, size), np.repeat(begin, size) + offset
