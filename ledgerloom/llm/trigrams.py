"""Boolean trigram queries of regular expressions, and an inverted index that answers them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np

# A query is True (any text may match), a trigram, or ("and" | "or", operands).
Query = bool | str | tuple

MOST_STRINGS = 64


def _join(kind: str, parts: Sequence[Query]) -> Query:
    """The parts combined; True is neutral to "and" and decides "or"."""
    flat: list[Query] = []
    for part in parts:
        if part is True:
            if kind == "or":
                return True
        elif isinstance(part, tuple) and part[0] == kind:
            flat += part[1]
        else:
            flat.append(part)
    distinct = list(dict.fromkeys(flat))
    if not distinct:
        return True
    return distinct[0] if len(distinct) == 1 else (kind, tuple(distinct))


def _of_strings(strings: frozenset[str]) -> Query:
    """One of the strings occurs."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass(frozen=True)
class _Part:
    """What a piece of an expression implies for the text it matches.

    ``exact``: all it can match, if few; else None. ``heads`` and ``tails``: how its
    matches begin and end. ``query``: what must occur inside.
    """

    exact: frozenset[str] | None
    heads: frozenset[str]
    tails: frozenset[str]
    query: Query


_NOTHING = frozenset([""])
_ANY = _Part(None, _NOTHING, _NOTHING, True)


def _strings(strings: set[str]) -> _Part:
    exact = frozenset(strings)
    return _Part(exact, exact, exact, True)


def _open(part: _Part) -> _Part:
    """The same piece, its strings no longer told in full."""
    if part.exact is None:
        return part
    return _Part(
        None, frozenset(s[:2] for s in part.exact), frozenset(s[-2:] for s in part.exact), _of_strings(part.exact)
    )


def _few(strings: set[str]) -> frozenset[str]:
    return frozenset(strings) if len(strings) <= MOST_STRINGS else _NOTHING


def _then(left: _Part, right: _Part) -> _Part:
    if left.exact is not None and right.exact is not None and len(left.exact) * len(right.exact) <= MOST_STRINGS:
        return _strings({a + b for a, b in product(left.exact, right.exact)})
    seam = _few({a + b for a, b in product(left.tails, right.heads)})
    heads = {a + b for a, b in product(left.exact, right.heads)} if left.exact is not None else left.heads
    tails = {a + b for a, b in product(left.tails, right.exact)} if right.exact is not None else right.tails
    query = _join("and", [_open(left).query, _open(right).query, _of_strings(seam)])
    return _Part(None, _few(set(heads)), _few(set(tails)), query)


def _either(parts: list[_Part]) -> _Part:
    if all(part.exact is not None for part in parts):
        union = set().union(*(part.exact for part in parts))
        if len(union) <= MOST_STRINGS:
            return _strings(union)
    opened = [_open(part) for part in parts]
    return _Part(
        None,
        _few(set().union(*(part.heads for part in opened))),
        _few(set().union(*(part.tails for part in opened))),
        _join("or", [part.query for part in opened]),
    )


def _characters(items: list) -> set[str] | None:
    """The characters of a class in lower case, if they are few."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 16:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 10 else None


def _piece(kind, value) -> _Part:
    if kind is op.LITERAL:
        return _strings({chr(value).lower()})
    if kind is op.IN:
        characters = _characters(value)
        return _ANY if characters is None else _strings(characters)
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        return _either([_sequence(branch) for branch in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, body = value
        if most == 0:
            return _strings({""})
        inner = _sequence(body)
        if least == 0:
            return _either([_strings({""}), inner]) if most == 1 else _ANY
        return inner if most == 1 else _open(inner)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return _strings({""})
    return _ANY


def _sequence(nodes) -> _Part:
    part = _strings({""})
    for kind, value in nodes:
        part = _then(part, _piece(kind, value))
    return part


def query_of(pattern: re.Pattern) -> Query:
    """What must occur, in lower case, in every text the pattern matches; True if nothing must."""
    return _open(_sequence(_parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE))).query


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*(trigrams_of(part) for part in query[1]))
    return {query} if isinstance(query, str) else set()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Index:
    """Postings of a block of texts (UTF-8), for the trigrams some queries ask for."""

    def __init__(self, trigrams: Sequence[str]):
        # Trigrams beyond ASCII are not looked up: a query may only drop what it need not ask.
        self.numbers = {t: i + 1 for i, t in enumerate(sorted(trigrams)) if t.isascii()}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for trigram, number in self.numbers.items():
            a, b, c = trigram.encode()
            self.table[a << 16 | b << 8 | c] = number
        self.size = 0
        self.postings: dict[int, np.ndarray] = {}

    def build(self, texts: list[bytes]) -> None:
        """Replace the postings by those of these texts."""
        self.size, self.postings = len(texts), {}
        data = _LOWER[np.frombuffer(b"\xff\xff".join(texts), dtype=np.uint8)]  # 0xff is in no text
        starts = np.cumsum([0] + [len(text) + 2 for text in texts[:-1]])
        if len(data) < 3:
            return
        code = data[:-2].astype(np.uint32) << 16
        code |= data[1:-1].astype(np.uint32) << 8
        code |= data[2:]
        number = self.table[code]
        at = np.flatnonzero(number)
        text = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(number[at].astype(np.int64) * len(texts) + text)
        owner = pairs // len(texts)
        for found in np.unique(owner):
            self.postings[int(found)] = pairs[owner == found] % len(texts)

    def answer(self, query: Query) -> np.ndarray:
        """Sorted numbers of the texts that may match."""
        if query is True or isinstance(query, str) and query not in self.numbers:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings.get(self.numbers[query], np.empty(0, dtype=np.int64))
        parts = [self.answer(part) for part in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True)
        return out
