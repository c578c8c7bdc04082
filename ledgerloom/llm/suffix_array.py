"""Suffix arrays by linear grouping, and the repeats of a set of byte strings from them."""

from __future__ import annotations

from functools import cache

import numpy as np

from ledgerloom.llm.shingling import U64, mix


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order; a suffix that is a prefix comes first.

    First phase: suffixes start grouped by first symbol. Groups are taken in descending
    order; each member's pointer goes to the closest earlier position of a lower group, and
    positions that as many members point to move up together, right above what stays of
    their group. In the end a group holds the suffixes with one Lyndon prefix. Second
    phase: in ascending order, each suffix fixes the place of the one before it and of
    those along its pointers. No renaming, no recursion.
    """
    n = len(symbols)
    if not n:
        return []
    # A group is known by its first place in the order; ``first_of[end]`` finds it by its end.
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        by_symbol.setdefault(symbol, []).append(i)
    group = [0] * n
    members: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    first_of = [0] * (n + 1)
    place = 0
    for symbol in sorted(by_symbol):
        own = by_symbol[symbol]
        members[place], size[place] = own, len(own)
        for i in own:
            group[i] = place
        first_of[place + len(own)] = place
        place += len(own)

    before = [-1] * n
    end = n
    while end:
        first = first_of[end]
        count: dict[int, int] = {}
        for i in sorted(members[first]) if len(members[first]) > 1 else members[first]:
            if group[i] != first:
                continue  # moved up since it was listed
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            by_count: dict[int, dict[int, list[int]]] = {}
            for p, pointed in count.items():
                by_count.setdefault(pointed, {}).setdefault(group[p], []).append(p)
            for pointed in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
                # Groups as they are now: those pointed at more often have left already.
                for lower, moving in by_count[pointed].items():
                    left = size[lower] - len(moving)
                    if not left:
                        continue
                    new = lower + left
                    size[lower], size[new], members[new] = left, len(moving), moving
                    first_of[new + len(moving)], first_of[new] = new, lower
                    for p in moving:
                        group[p] = new
        end = first

    order = [-1] * n
    free = dict(size)
    placed = bytearray(n)
    # What ends the text is the smallest suffix; it and its pointers come first.
    p = n - 1
    at = 0
    while True:
        while p >= 0 and not placed[p]:
            first = group[p]
            order[first + size[first] - free[first]] = p
            free[first] -= 1
            placed[p] = 1
            p = before[p]
        if at == n:
            return order
        p = order[at] - 1
        at += 1


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(23)
# Half of the bytes may start a phrase; a phrase then spans about two words.
_OPENS = (_RANDOM.random(256) < 0.5) & ~_SPACE
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=U64)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


# Powers of the base and of its inverse, computed once a process for arrays up to this long.
_TABLED = 2**20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, _TABLED + 1), _powers(_INVERSE, _TABLED + 1)


class Prefixes:
    """Hashes of all substrings of a byte array, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n <= _TABLED:
            powers, self.back = (table[: n + 1] for table in _tables())
        else:
            powers, self.back = _powers(_BASE, n), _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U64))

    def every(self, length: int) -> np.ndarray:
        """The hashes of all substrings of that length, by where they start."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n] + U64(length))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def repeated_windows(texts: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each text, which windows at 0 .. starts-1 equal a window of some text at another place.

    Texts are valid UTF-8 pieces (no byte 0xff) of at least ``starts + length - 1`` bytes.
    They are parsed into phrases that begin where the bytes themselves say so, phrases are
    ranked in byte order, and the suffixes of the phrase string are sorted. A window is
    what precedes the first phrase in it, and a stretch of the suffix from there; windows
    are equal if the former are and the latter lie in one run of the suffix array whose
    common prefixes are long enough.
    """
    data = b"\xff".join(texts) + b"\xff"
    a = np.frombuffer(data, dtype=np.uint8)
    sizes = np.array([len(text) for text in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    opens = np.zeros(len(a), bool)
    opens[1:] = _SPACE[a[:-1]] & _OPENS[a[1:]]
    own = np.flatnonzero(opens)  # never at a separator or a text's first byte
    cuts = np.union1d(np.union1d(own, begin), begin + sizes)
    edges = np.append(cuts, len(a)).tolist()
    phrases = [data[s:e] for s, e in zip(edges, edges[1:])]
    ranks = {phrase: i + 1 for i, phrase in enumerate(sorted(set(phrases) - {b"\xff"}))}
    ranks[b"\xff"] = 0
    symbols = [ranks[phrase] for phrase in phrases]
    order = suffix_array(symbols)

    first = np.repeat(begin, starts) + np.concatenate([np.arange(n) for n in starts])
    nearest = np.searchsorted(own, first, side="right")
    padded = np.append(own, len(a) + length)
    gap = np.minimum(padded[nearest] - first, length)

    # Common prefixes, in bytes, of neighbours in the suffix array.
    n = len(symbols)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    shared = np.zeros(n, dtype=np.int64)
    inner = gap[gap < length]
    least = length - int(inner.max()) if len(inner) else length
    h = 0
    for i in range(n):
        r = rank[i]
        if not r or not symbols[i]:
            h = 0
            continue
        j = order[r - 1]
        while symbols[i + h] == symbols[j + h] and symbols[i + h]:
            h += 1
        bytes_shared = edges[i + h] - edges[i]
        x, y = phrases[i + h], phrases[j + h]
        if bytes_shared < length and bytes_shared + min(len(x), len(y)) >= least:
            bytes_shared += _common(x, y) if x != b"\xff" != y else 0
        shared[r] = bytes_shared
        if h:
            h -= 1

    hashes = Prefixes(a)
    place = np.array(rank)
    repeated = np.zeros(len(first), bool)
    symbol_at = np.searchsorted(cuts, padded[nearest])
    for d in np.unique(gap).tolist():
        here = np.flatnonzero(gap == d)
        key = hashes.of(first[here], first[here] + d)
        if d < length:
            run = np.cumsum(shared < length - d)
            key = mix(key + run[place[symbol_at[here]]].astype(U64) * _BASE)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        repeated[here] = count[which] > 1
    return np.split(repeated, np.cumsum(starts)[:-1])
