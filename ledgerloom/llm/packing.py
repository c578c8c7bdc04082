"""Packing along a space-filling curve: neighbours in content share training sequences.

1. One pass tokenizes every whole text and keeps, per document, its length, the checksums
   of its runs of ``RUN`` ids, and a Hilbert key: signed hashed counts of its ids,
   normalised, projected to three fixed directions and put on the curve. Ids themselves
   are kept only on demand. The table is written, so that no later step tokenizes again.
2. Rows are range-partitioned and sorted by key; doc_id and a row number break ties, so
   copies, however many, spread over partitions.
3. Each partition lays its documents end to end into sequences of ``LENGTH`` ids and cuts
   them at multiples of ``RUN`` ids, where checksums are known; a piece's checksum is
   combined from those of its runs. A sequence ends early by less than ``RUN`` ids, and
   the last one of a partition wherever its documents end.

A partition holds at most its share of documents, and sequence ids number partition and
place, so a lost task packs the same pieces again.

Defined cases: null and empty texts are the end mark alone; null doc_ids are packed like
others; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

LENGTH = 1024
RUN = 16
END = 0
REMEMBERED = 200_000
SEQUENCES = 64  # per partition, at least

_BUCKETS, _DIRECTIONS, _BITS = 128, 3, 16


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as characters: printable ones as themselves, the
    others, in order, as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + i): byte for i, byte in enumerate(others)}


@functools.cache
def _file(path: str | None) -> dict:
    """A tokenizers file, the public 50k one by default."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return json.load(file)


def added_tokens(path: str | None) -> dict[str, int]:
    """The strings that a tokenizers file takes out of a text before anything else, and their ids."""
    added = _file(path).get("added_tokens") or []
    for token in added:
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip") or token["id"] >= 2**16:
            raise ValueError(f"added token {token['content']!r} cannot be encoded here")
    return {token["content"]: token["id"] for token in added}


@functools.cache
def encoding(path: str | None):
    """The byte-level BPE of a tokenizers file (the public 50k one by default), as ranks.

    Added tokens are not part of it.
    """
    import public_tokenizers
    import tiktoken

    model = _file(path)["model"]
    spelled = byte_of_symbol()
    ranks = {}
    for symbols, number in model["vocab"].items():
        if all(symbol in spelled for symbol in symbols) and number < 2**16:
            ranks[bytes(spelled[symbol] for symbol in symbols)] = number
    # Special tokens are whole strings that no merge makes.
    made = {a + b for a, b in (merge if isinstance(merge, list) else merge.split(" ") for merge in model["merges"])}
    merged = {bytes(spelled[symbol] for symbol in symbols) for symbols in made}
    ranks = {piece: number for piece, number in ranks.items() if len(piece) == 1 or piece in merged}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts as 16-bit numbers, remembering words.

    A space between two characters that are none always starts a new token, whatever is
    around it, so a text may be encoded word by word. A word with white space at either
    side is not remembered, and its text is encoded in one go. Added tokens cut a text into
    stretches, which are encoded as if they were texts.
    """

    def __init__(self, path: str | None):
        self.encode = encoding(path).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.added = {token: array("H", [number]).tobytes() for token, number in added_tokens(path).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None

    def _whole(self, text: str) -> bytes:
        return array("H", self.encode(text)).tobytes()

    def ids(self, text: str) -> np.ndarray:
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1:
            return self._numbers(self._stretch(text))
        return self._numbers(b"".join(self.added.get(part) or self._stretch(part) for part in parts if part))

    def _stretch(self, text: str) -> bytes:
        words = text.split(" ")
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for word in set(words[1:]).difference(known):
            if not word or word[0].isspace() or word[-1].isspace():
                return self._whole(text)
            known[word] = self._whole(" " + word)
        if words[0] and words[0][-1].isspace() or len(words) > 1 and not words[0]:
            return self._whole(text)
        return self._whole(words[0]) + b"".join(map(known.__getitem__, words[1:]))

    @staticmethod
    def _numbers(data: bytes) -> np.ndarray:
        return np.frombuffer(data + END.to_bytes(2, sys.byteorder), dtype=np.uint16)


_RANDOM = np.random.default_rng(11)
_BUCKET = _RANDOM.integers(0, _BUCKETS, 2**16)
_SIGN = _RANDOM.choice(np.array([-1.0, 1.0]), 2**16)
_PROJECTION = _RANDOM.normal(size=(_BUCKETS, _DIRECTIONS))


def coordinates(ids: np.ndarray) -> np.ndarray:
    """A document's place in a cube of 2**16 cells a side."""
    counts = np.bincount(_BUCKET[ids], weights=_SIGN[ids], minlength=_BUCKETS)
    place = counts @ _PROJECTION / max(np.sqrt(counts @ counts), 1e-9)
    return ((np.tanh(place / 1.5) + 1) / 2 * (2**_BITS - 1)).astype(np.int64)


def hilbert(places: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Position along the Hilbert curve of rows of coordinates of that many bits."""
    x = [places[:, i].copy() for i in range(places.shape[1])]
    # Undo the rotations and reflections of the curve from the coarsest cells down.
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in x:
            upper = (axis >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(upper, below, swap)
            if axis is not x[0]:
                axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> level & 1)
    return key


_ZEROS = bytes(4 * RUN)
_PLAIN = [zlib.crc32(_ZEROS[: 4 * n]) for n in range(RUN + 1)]


def joined_checksum(first: int, second: int, length: int) -> int:
    """crc32 of two stretches of ids, the second of that many (at most RUN)."""
    return zlib.crc32(_ZEROS[: 4 * length], first) ^ _PLAIN[length] ^ second


def tokenized(documents: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, doc_tokens, checksums, hilbert, ids) per row; ``ids`` null unless asked for."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            sizes, sums, places, kept = [], [], [], []
            for text in batch.column("text"):
                ids = encoder.ids(text.as_py() or "")
                data = memoryview(ids.astype("<u4").tobytes())
                sizes.append(len(ids))
                sums.append(array("I", [zlib.crc32(data[at : at + 4 * RUN]) for at in range(0, len(data), 4 * RUN)]).tobytes())
                places.append(coordinates(ids))
                kept.append(ids.tobytes() if with_ids else None)
            keys = hilbert(np.array(places, dtype=np.int64).reshape(-1, _DIRECTIONS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.binary()),
                    pa.array(keys, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "doc_tokens", "checksums", "hilbert", "ids"],
            )

    schema = "doc_id long, doc_tokens long, checksums binary, hilbert long, ids binary"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)


class Layout:
    """Documents laid end to end into sequences, cut at multiples of ``RUN`` ids."""

    def __init__(self, length: int):
        self.length, self.sequence, self.offset = length, 0, 0

    def place(self, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, count, sequence, offset) of the pieces of the next document."""
        start = 0
        while start < size:
            room = self.length - self.offset
            count = size - start if size - start <= room else room // RUN * RUN
            if count:
                yield start, count, self.sequence, self.offset
                start += count
                self.offset += count
            if start < size or self.offset == self.length:
                self.sequence, self.offset = self.sequence + 1, 0


def pack(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) per piece.

    ``ids``: the piece's ids as 16-bit numbers; null unless asked for.
    """
    rows = stored(tokenized(documents, tokenizer, with_ids), "tokenized")
    order = ["hilbert", "doc_id", "row"]
    # A partition leaves one sequence unfinished, so small tables get fewer of them.
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    most = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, total // (length * SEQUENCES)))
    sorted_rows = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .drop("hilbert", "row")
    )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, first = Layout(length), TaskContext.get().partitionId() << 40
        for batch in batches:
            owner, sums, pieces, kept = [], [], [], []
            for number, size in enumerate(batch.column("doc_tokens").to_pylist()):
                runs = np.frombuffer(batch.column("checksums")[number].as_buffer(), np.uint32).tolist()
                ids = batch.column("ids")[number].as_py()
                for start, count, sequence, offset in layout.place(size):
                    checksum, left = 0, count
                    for run in runs[start // RUN : (start + count + RUN - 1) // RUN]:
                        checksum = joined_checksum(checksum, run, min(left, RUN))
                        left -= RUN
                    owner.append(number)
                    sums.append(checksum)
                    pieces.append((start, count, first + sequence, offset))
                    kept.append(None if ids is None else ids[2 * start : 2 * (start + count)])
            start, count, sequence, offset = np.array(pieces, dtype=np.int64).reshape(-1, 4).T
            owners = pa.array(owner, pa.int64())
            columns = {
                "doc_id": batch.column("doc_id").take(owners),
                "start": pa.array(start),
                "length": pa.array(count),
                "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": batch.column("doc_tokens").take(owners),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(offset),
                "ids": pa.array(kept, pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return sorted_rows.mapInArrow(
        lay,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def report(documents: DataFrame) -> DataFrame:
    """The query's columns."""
    return pack(documents).drop("ids")
