"""Periodic runs of words: stretches that repeat a block of words three times or more.

1. Texts are cut into words; some documents' words at a time form one enhanced suffix array
   (suffix order, its inverse, common prefixes), in which documents stay apart.
2. A run with period q ends in a square: a block of q words twice, not followed by the word
   that would go on. Both places of the block lie in one LCP interval of depth q, and in
   different children of it. So for each interval the suffixes i of all but its largest child
   are tested: is i + q, or i - q, in the interval too, by the inverse? Intervals are numbers
   in arrays; no tree is built.
3. Squares are rotated to the left, word by word, as far as the period goes on; all
   rotations of one square are one run. Of runs over the same stretch that with the smallest
   period counts.

Each row is handled alone, in bounded groups of rows within a task; nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs; a null doc_id is a row
like others; repeated rows give one result each; a very long text is one suffix array, of about a
hundred bytes a word; an empty table gives no rows. Columns other than doc_id and text are ignored
by ``runs`` and ``report`` and kept by ``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.lcp_intervals import intervals, smaller_children, suffix_order

AT_LEAST = 24
TIMES = 3
GROUP_WORDS = 200_000  # of the documents that share a suffix array; a longer one has its own

_STEPS = 32

Run = tuple[int, int, int]  # start, length, period


def squares(symbols: np.ndarray, sizes: np.ndarray, at_least: int = AT_LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the last square of every run, and of some of its multiples."""
    end = np.repeat(np.cumsum(sizes), sizes)
    begin = end - np.repeat(sizes, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order, rank, shared = suffix_order(symbols, owner, end)
    depth, first, last, parted = intervals(shared)
    # A run of period q has its block at so many places, and is no longer than its document.
    needed = np.maximum(at_least // np.maximum(depth, 1), times)
    home = order[first]
    wanted = (last - first + 1 >= needed) & (np.maximum(depth * times, at_least) <= (end - begin)[home])
    interval, position = smaller_children(first, last, parted, wanted)
    i, q = order[position], depth[interval]
    low, high = first[interval], last[interval]
    found = []
    for other, left in ((i + q, i), (i - q, i - q)):
        inside = (other >= begin[i]) & (other < end[i])
        at = rank[np.where(inside, other, i)]
        inside &= (at >= low) & (at <= high)
        place, period = left[inside], q[inside]
        after = place + 2 * period
        goes_on = after < end[place]
        goes_on &= symbols[np.where(goes_on, after, place)] == symbols[place + period]
        found.append(np.stack((place[~goes_on], period[~goes_on])))
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def _further(symbols: np.ndarray, place: int, period: int, begin: int) -> int:
    """How many words to the left of a place the period goes on."""
    at, chunk = place, 256
    while at > begin:
        low = max(begin, at - chunk)
        differ = np.flatnonzero(symbols[low:at] != symbols[low + period : at + period])
        if len(differ):
            return place - (low + int(differ[-1]) + 1)
        at, chunk = low, chunk * 4
    return place - begin


def find_runs(words: list[np.ndarray], at_least: int = AT_LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each document, by start, then period; ``words`` are their words as numbers.

    A run is a longest stretch with smallest period q and of max(at_least, times * q) words or more.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    out: list[list[Run]] = [[] for _ in words]
    if not sizes.sum():
        return out
    symbols = np.concatenate(words)
    bounds = np.cumsum(sizes)
    place, period = squares(symbols, sizes, at_least, times)
    document = np.searchsorted(bounds, place, side="right")
    begin = bounds[document] - sizes[document]
    # Rotations that a run of the least size has at least.
    needed = np.maximum(at_least, times * period) - 2 * period
    keep = np.ones(len(place), bool)
    for step in range(1, _STEPS + 1):
        going = np.flatnonzero(keep & (needed >= step))
        to = place[going] - step
        same = to >= begin[going]
        same &= symbols[np.maximum(to, 0)] == symbols[np.maximum(to, 0) + period[going]]
        keep[going[~same]] = False
    rows = np.flatnonzero(keep)
    rows = rows[np.lexsort((period[rows], place[rows] + 2 * period[rows]))]
    stop, own = -1, []
    for row in rows.tolist():
        i, q, d, b = int(place[row]), int(period[row]), int(document[row]), int(begin[row])
        if i + 2 * q != stop:
            stop, own = i + 2 * q, []
        if any(i >= start and q % smaller == 0 for start, smaller in own):
            continue  # a multiple of a smaller period of the same stretch
        turned = _further(symbols, i, q, b)
        own.append((i - turned, q))
        if turned >= needed[row]:
            out[d].append((i - turned - b, turned + 2 * q, q))
    return [sorted(found, key=lambda run: (run[0], run[2])) for found in out]


def strongest(found: list[Run]) -> Run | None:
    """The run with the most repetitions; among equals the first, then that of the smallest period."""
    return max(found, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2]), default=None)


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay if only a run's first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _words(text: bytes | None) -> list[bytes]:
    """Bytes 0x09 to 0x0D and the space part words."""
    return (text or b"").split()


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repeating tail, in one document of ten, as its id says; not without an id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def _with_runs(
    batch: pa.RecordBatch, at_least: int, times: int, tails: bool
) -> Iterator[tuple[int, list[bytes], list[Run]]]:
    """(row, words, runs) of every row, in order."""
    held: list[list[bytes]] = []
    first = total = 0

    def flush() -> Iterator[tuple[int, list[bytes], list[Run]]]:
        number: dict[bytes, int] = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in held]
        yield from ((first + i, words, found) for i, (words, found) in enumerate(zip(held, find_runs(coded, at_least, times))))

    ids = batch.column("doc_id").to_pylist() if tails else None
    for row, text in enumerate(batch.column("text").cast(pa.binary())):
        words = _words(text.as_py())
        if tails:
            words = repeated_tail(words, ids[row])
        if held and total + len(words) > GROUP_WORDS:
            yield from flush()
            held, first, total = [], row, 0
        held.append(words)
        total += len(words)
    if held:
        yield from flush()


def _mapped(documents: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return documents.mapInArrow(apply, schema)


def runs(documents: DataFrame, at_least: int = AT_LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, start, length, period): a row for every run, in words."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *run) for i, _, found in _with_runs(batch, at_least, times, False) for run in found]
        owner, *columns = np.array(rows, np.int64).reshape(-1, 4).T
        own = batch.column("doc_id").take(pa.array(owner))
        return pa.RecordBatch.from_arrays([own, *map(pa.array, columns)], names=["doc_id", "start", "length", "period"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _mapped(documents.select("doc_id", "text"), make, f"doc_id {kind}, start long, length long, period long")


def collapse(documents: DataFrame, at_least: int = AT_LEAST, times: int = TIMES) -> DataFrame:
    """All rows and columns; of every run only its first period stays, in texts that have any.

    The words of a text that changes are joined by single spaces.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        for row, words, found in _with_runs(batch, at_least, times, False):
            if found:
                keep = kept_words(len(words), found)
                texts[row] = b" ".join([w for w, stays in zip(words, keep.tolist()) if stays]).decode("utf-8", "replace")
        at = batch.schema.get_field_index("text")
        field = batch.schema.field(at)
        return batch.set_column(at, field, pa.array(texts, field.type))

    return _mapped(documents, make, documents.schema)


def report(documents: DataFrame) -> DataFrame:
    """The query's columns: runs of the words with their repeating tails."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for _, words, found in _with_runs(batch, AT_LEAST, TIMES, True):
            listed = "".join(f"{start},{length},{period}\n" for start, length, period in found)
            if found:
                keep = kept_words(len(words), found).tolist()
                words = [w for w, stays in zip(words, keep) if stays]
            start, length, period = strongest(found) or (None, None, None)
            milli = None if period is None else 1000 * length // period
            digests = (hashlib.sha256(data).hexdigest() for data in (listed.encode(), b" ".join(words)))
            rows.append((len(found), start, length, period, milli, *digests))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _mapped(
        documents.select("doc_id", "text"),
        make,
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string",
    )
