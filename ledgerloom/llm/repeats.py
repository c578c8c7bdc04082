"""Suffix-array deduplication: bytes of passages that occur more than once are removed.

A byte goes if it is in a string of ``LENGTH`` bytes that starts anywhere else too, in the
same document or another.

1. Every window of that length is assigned to its anchor, the least of its hashed grams,
   leftmost among equals. Equal windows have the same anchor at the same offset, so only
   documents' stretches (runs of windows with one anchor) with the same anchor hash
   need be compared. Anchors that occur once are dropped.
2. Stretches with equal bytes are one class. If it has several members, all their windows
   are repeated.
3. Equal windows also have the anchor's whole left or right half of a window in common.
   Classes that share neither half with another class are done. The others meet in one task
   per anchor. It sorts the suffixes of their texts by the linear grouping construction and
   reads repeated windows from the suffix array. Anchors with more than ``MOST_CLASSES`` such
   classes would be too much for a task; the windows of these are counted one by one, by
   128-bit hashes, over all tasks.
4. The repeated windows of a document are merged and cut out of its bytes.

Defined cases: null texts are empty, and texts shorter than a window lose nothing; null
doc_ids and repeated rows give one result each, and a repeated row is another place, so
its text goes if it is as long as a window; very long texts are cut into chunks of windows
that overlap by a window; an empty table gives no rows. Columns other than doc_id and text
are ignored by ``removed`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import broadcast_up_to, stored, text_key
from ledgerloom.llm.shingling import U64, mix
from ledgerloom.llm.suffix_array import Prefixes, repeated_windows

LENGTH = 200
GRAM = 16
HALF = (LENGTH - GRAM) // 2
BLOCK = 250_000  # bytes of short texts that are hashed together
CHUNK = 1_000_000  # windows; positions in a chunk take 24 bits
MOST_CLASSES = 20_000
TASK_BYTES = 400_000  # of text per suffix array, if no single anchor has more

# One long each, some 30 bytes as a hash table.
BROADCAST_ANCHORS = 2_000_000

_LOW = U64(2**24 - 1)


def _blocks(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(texts' numbers, first bytes, bytes) of the chunks of texts, some at a time; a text shorter
    than a window has none."""
    owner, base, chunks, size = [], [], [], 0
    for i, text in enumerate(texts):
        for first in range(0, len(text) - LENGTH + 1, CHUNK):
            chunk = text[first : first + CHUNK + LENGTH - 1]
            if chunks and size + len(chunk) > BLOCK:
                yield owner, base, chunks
                owner, base, chunks, size = [], [], [], 0
            owner.append(i)
            base.append(first)
            chunks.append(chunk)
            size += len(chunk)
    if chunks:
        yield owner, base, chunks


def _least_grams(hashes: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams, and for every window where its least gram is."""
    grams = hashes.every(GRAM)
    width = LENGTH - GRAM + 1
    n = len(grams) - width + 1
    # Least value of every window: of a block's end and the next one's beginning.
    keyed = (grams & ~_LOW) | np.arange(len(grams)).astype(U64)
    blocks = np.append(keyed, np.full(-len(keyed) % width, 2**64 - 1, dtype=U64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return grams, (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)


@dataclass(frozen=True)
class Stretches:
    """Stretches of some texts. ``left`` and ``right`` are hashes of what equal windows have in
    common, whichever they are: an anchor lies at least ``HALF`` bytes from a window's start or
    as far as the other half from its end, so the bytes from there to the anchor's end, or from
    the anchor to there, are in the window. Without such windows they are masked."""

    owner: np.ndarray  # number of the text
    start: np.ndarray  # first window
    count: np.ndarray  # of windows
    anchor: np.ndarray
    whole: np.ndarray | None = None  # hash of the bytes
    left: np.ma.MaskedArray | None = None
    right: np.ma.MaskedArray | None = None


def _found(texts: Iterable[bytes], hashed: bool = True) -> Iterator[Stretches]:
    """The stretches of the texts, of all chunks of a block at once."""
    for owner, base, chunks in _blocks(texts):
        data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        sizes = np.array([len(chunk) for chunk in chunks])
        begin = np.cumsum(sizes) - sizes
        hashes = Prefixes(data)
        grams, least = _least_grams(hashes)
        inside = np.ones(len(least), bool)  # windows that reach into the next chunk are none
        for end in (begin[1:] - LENGTH + 1).tolist():
            inside[end : end + LENGTH - 1] = False
        windows = np.flatnonzero(inside)
        anchor = least[windows]
        first = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)
        at, start, count = anchor[first], windows[first], np.diff(np.append(first, len(anchor)))
        chunk = np.searchsorted(begin, start, side="right") - 1
        place = (np.array(owner)[chunk], start - begin[chunk] + np.array(base)[chunk], count, grams[at])
        if not hashed:
            yield Stretches(*place)
            continue
        whole = mix(hashes.of(start, start + count + LENGTH - 1) ^ U64(0x5851F42D4C957F2D))
        lefts, rights = at - start >= HALF, at - (start + count - 1) <= HALF
        left = hashes.of(np.where(lefts, at - HALF, at), at + GRAM) ^ U64(0x14057B7EF767814F)
        right = hashes.of(at, np.where(rights, at + LENGTH - HALF, at + GRAM))
        yield Stretches(*place, whole, np.ma.array(left, mask=~lefts), np.ma.array(right, mask=~rights))


def stretches(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first windows, numbers of windows, anchor hashes, hashes of the bytes) of a text's stretches."""
    for part in _found([text]):
        yield part.start, part.count, part.anchor, part.whole


def _signed(values: np.ndarray) -> pa.Array:
    if isinstance(values, np.ma.MaskedArray):
        return pa.array(values.data.view(np.int64), mask=values.mask)
    return pa.array(values.view(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield text.as_py() or b""


def _anchors(documents: DataFrame) -> DataFrame:
    """(anchor, n): anchors with their numbers of stretches, counted per batch already."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [part.anchor for part in _found(_texts(batch), hashed=False)]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(n, pa.int64())], names=["anchor", "n"])

    return documents.select("text").mapInArrow(count, "anchor long, n long")


_STRETCH = (
    "doc_id long, text_key long, start long, count long, anchor long, bytes_key long, left_key long, right_key long"
)


def _all_stretches(rows: DataFrame) -> DataFrame:
    """Every stretch with its hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _found(_texts(batch)):
                owners = pa.array(part.owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(owners),
                        batch.column("text_key").take(owners),
                        pa.array(part.start, pa.int64()),
                        pa.array(part.count, pa.int64()),
                        *map(_signed, (part.anchor, part.whole, part.left, part.right)),
                    ],
                    names=["doc_id", "text_key", "start", "count", "anchor", "bytes_key", "left_key", "right_key"],
                )

    return rows.mapInArrow(cut, _STRETCH)


def _meeting(classes: DataFrame) -> DataFrame:
    """(anchor, bytes_key) of the classes that may have a window in common with another class,
    one of the two having one member. Equal windows have equal left or right keys."""
    halves = classes.select(
        "anchor", "bytes_key", "n", F.explode(F.array_compact(F.array("member.left_key", "member.right_key"))).alias("half")
    )
    common = halves.groupBy("half").agg(F.count("*").alias("n_classes"), F.count_if(F.col("n") == 1).alias("n_single"))
    several = common.where("n_classes > 1 AND n_single > 0").select("half")
    return halves.join(several, "half", "left_semi").select("anchor", "bytes_key").distinct()


_CLASS = "anchor long, single boolean, crowded boolean, start long, count long"
_PIECE = f"doc_id long, text_key long, {_CLASS}, piece binary"


def _pieces(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes with their bytes, from the text of one member each."""
    listed = classes.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("anchor", "single", "crowded", "start", "count")).alias("classes")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset in range(0, batch.num_rows, 100):
                part = batch.slice(offset, 100)
                texts, listed = list(_texts(part)), part.column("classes")
                own = pa.RecordBatch.from_struct_array(listed.flatten())
                owner = listed.value_parent_indices()
                place = zip(owner.to_pylist(), own.column("start").to_pylist(), own.column("count").to_pylist())
                pieces = [texts[i][s : s + n + LENGTH - 1] for i, s, n in place]
                keys = [part.column(name).take(owner) for name in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *own.columns, pa.array(pieces, pa.binary())],
                    names=["doc_id", "text_key", *own.schema.names, "piece"],
                )

    same = rows["doc_id"].eqNullSafe(listed["doc_id"]) & (rows["text_key"] == listed["text_key"])
    joined = rows.join(listed, same).select(rows["doc_id"], rows["text_key"], "text", "classes")
    return joined.mapInArrow(cut, _PIECE)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    change = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return change[::2], change[1::2]


_FOUND = "doc_id long, text_key long, first long, last long"


def _by_suffix_arrays(pieces: DataFrame) -> DataFrame:
    """Spans of repeated windows in the classes of one member; an anchor's lie in one task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            count = table.column("count").to_pylist()
            flags = repeated_windows(table.column("piece").to_pylist(), count, LENGTH)
            owner, first, last = [], [], []
            for i, single in enumerate(table.column("single").to_pylist()):
                if single and flags[i].any():
                    starts, ends = _spans(flags[i])
                    owner.append(np.full(len(starts), i))
                    first.append(starts)
                    last.append(ends)
            if owner:
                owners = pa.array(np.concatenate(owner))
                base = table.column("start").to_numpy()[np.concatenate(owner)]
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("doc_id").take(owners).combine_chunks(),
                        table.column("text_key").take(owners).combine_chunks(),
                        pa.array(base + np.concatenate(first)),
                        pa.array(base + np.concatenate(last)),
                    ],
                    names=["doc_id", "text_key", "first", "last"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(anchor)]
            ends = np.cumsum(batch.column("count").to_numpy() + LENGTH - 1)
            for start, end in zip(cuts, cuts[1:]):
                if held and size >= TASK_BYTES and held[-1].column("anchor")[-1].as_py() != anchor[start]:
                    yield from flush()
                    held, size = [], 0
                held.append(batch.slice(start, end - start))
                size += int(ends[end - 1] - (ends[start - 1] if start else 0))
        if held:
            yield from flush()

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(find, _FOUND)


def _by_counting(pieces: DataFrame) -> DataFrame:
    """The same for crowded anchors: equal windows counted by hash, wherever they are."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, keys, checks = [], [], [], []
            for i, piece in enumerate(batch.column("piece").to_pylist()):
                hashes = Prefixes(np.frombuffer(piece, dtype=np.uint8))
                at = np.arange(len(piece) - LENGTH + 1)
                half = LENGTH // 2
                owner.append(np.full(len(at), i))
                place.append(at)
                keys.append(hashes.of(at, at + LENGTH))
                checks.append(mix(hashes.of(at, at + half) ^ U64(0x2545F4914F6CDD1D)))
            if owner:
                owners = pa.array(np.concatenate(owner))
                base = batch.column("start").to_numpy()[np.concatenate(owner)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(owners),
                        batch.column("text_key").take(owners),
                        batch.column("single").take(owners),
                        pa.array(base + np.concatenate(place)),
                        _signed(np.concatenate(keys)),
                        _signed(np.concatenate(checks)),
                    ],
                    names=["doc_id", "text_key", "single", "first", "key", "check"],
                )

    windows = pieces.mapInArrow(
        explode, "doc_id long, text_key long, single boolean, first long, key long, `check` long"
    )
    repeated = windows.groupBy("key", "check").agg(F.count("*").alias("n")).where("n > 1").select("key", "check")
    return windows.where("single").join(repeated, ["key", "check"]).select(
        "doc_id", "text_key", "first", (F.col("first") + 1).alias("last")
    )


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): the documents with repeated windows, as (first, after the last)."""
    rows = documents.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    shared = stored(
        _anchors(documents).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors"
    )
    found = stored(_all_stretches(rows).join(broadcast_up_to(shared, BROADCAST_ANCHORS), "anchor"), "stretches")
    classes = stored(
        found.groupBy("anchor", "bytes_key").agg(
            F.count("*").alias("n"),
            F.min(F.struct("doc_id", "text_key", "start", "count", "left_key", "right_key")).alias("member"),
        ),
        "classes",
    )
    several = classes.where("n > 1").select("anchor", "bytes_key")
    whole = found.join(several, ["anchor", "bytes_key"], "left_semi").select(
        "doc_id", "text_key", F.col("start").alias("first"), (F.col("start") + F.col("count")).alias("last")
    )
    meeting = stored(_meeting(classes), "meeting")
    crowds = meeting.groupBy("anchor").agg(F.count("*").alias("n_classes"))
    members = stored(
        classes.join(meeting, ["anchor", "bytes_key"], "left_semi")
        .join(crowds, "anchor")
        .select(
            *[f"member.{name}" for name in ("doc_id", "text_key", "start", "count")],
            "anchor",
            (F.col("n") == 1).alias("single"),
            (F.col("n_classes") > MOST_CLASSES).alias("crowded"),
        ),
        "members",
    )
    pieces = stored(_pieces(rows, members), "pieces")
    partly = _by_suffix_arrays(pieces.where("NOT crowded")).union(_by_counting(pieces.where("crowded")))
    return whole.union(partly).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("first", "last")).alias("spans")
    )


def cut_out(text: bytes, windows: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays of the text, how many bytes go and in how many runs."""
    kept, removed, runs, reached = [], 0, 0, 0
    for first, last in sorted(windows):
        end = last - 1 + LENGTH
        if first > reached or not runs:
            kept.append(text[reached:first])
            runs += 1
            removed += end - first
            reached = end
        elif end > reached:
            removed += end - reached
            reached = end
    kept.append(text[reached:])
    return b"".join(kept), removed, runs


def _with_spans(documents: DataFrame) -> DataFrame:
    """The documents with their spans as ``__spans``."""
    side = spans(documents)
    same = documents["doc_id"].cast("long").eqNullSafe(side["doc_id"])
    joined = documents.join(side, same & (text_key(documents["text"]) == side["text_key"]), "left")
    return joined.select(*[documents[name] for name in documents.columns], side["spans"].alias("__spans"))


def _cuts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple[bytes, int, int]]]:
    for text, own in zip(_texts(batch), batch.column("__spans").to_pylist()):
        yield text, cut_out(text, [(s["first"], s["last"]) for s in own or []])


def removed(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(text), gone, runs, hashlib.sha256(kept).hexdigest()) for text, (kept, gone, runs) in _cuts(batch)]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = _with_spans(documents.select("doc_id", "text"))
    return rows.mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(documents: DataFrame) -> DataFrame:
    """All rows and columns, repeated passages cut out of ``text``.

    A cut inside a character leaves bytes of it, which are replaced as invalid ones are.
    """

    names = documents.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if null else kept.decode("utf-8", "replace")
                for null, (_, (kept, _, _)) in zip(batch.column("text").is_null().to_pylist(), _cuts(batch))
            ]
            at = batch.schema.get_field_index("text")
            whole = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield whole.select(names)

    return _with_spans(documents).mapInArrow(apply, documents.schema)


def report(documents: DataFrame) -> DataFrame:
    """The query's columns."""
    return removed(documents)
