"""Cross-tokenizer alignment: which ids of one vocabulary stand for which ids of another.

1. An array over vocabulary A gives for every id the B id with the same bytes, if there is one:
   the identity map.
2. Texts are encoded by both tokenizers and cut where tokens of both end. Between two
   characters that are no white space, a space starts a new token of either, so words are
   encoded and cut once a task and remembered; a text with other white space around
   a space is encoded whole. Links, that is A and B tokens that share bytes, are kept per
   document as distinct ids with their numbers: links by the identity map as A ids alone, the
   others as pairs. This table is written, so nothing is encoded twice.
3. Links by the identity map are counted in a vector of the vocabulary's length in each task;
   only the vectors meet. The other pairs are counted per block of documents first, and only
   these counts are shuffled.
4. Every block gets the counts of its own distinct pairs, and its documents add them up. What
   is sent to all tasks is two numbers per A id, whatever the corpus.

A block is a bounded group of neighbouring rows, so a pair that all documents hold takes a row
per block, and no task gathers more than a block and its pairs.

Defined cases: texts that are null or empty, or whose bytes either tokenizer changes, have no
tokens and zeros; strings of special tokens are ordinary text; null doc_ids and repeated rows
are documents like others; a very long text is a block of its own; an empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.packing import encoding
from ledgerloom.llm.shared import stored

REMEMBERED = 150_000  # words, and eight times as many links
ENCODED_WORDS = 4_000  # at once
BLOCK_CHARS, BLOCK_ROWS = 2_000_000, 4_000

_SPACE = "▁"
# White space at either end of a text, or beside a space.
_ODD_SPACE = re.compile(r"^\s|\s\Z|\s | \s")


@functools.cache
def _pieces(path: str | None):
    """The sentence-piece processor and the bytes of its ids."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    spelled = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            spelled.append(bytes([int(piece[3:5], 16)]))
        else:
            if _SPACE in piece.lstrip(_SPACE):
                raise ValueError(f"piece {piece!r} spans words")
            spelled.append(piece.replace(_SPACE, " ").encode())
    return model, spelled


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes], plain: list[bool]) -> np.ndarray:
    """For every A id the B id of the same bytes, or -1; pieces go before single-byte fallbacks."""
    by_bytes: dict[bytes, int] = {}
    for wanted in (True, False):
        for number, (piece, own) in enumerate(zip(b_bytes, plain)):
            if own == wanted:
                by_bytes.setdefault(piece, number)
    return np.array([by_bytes.get(piece, -1) for piece in a_bytes], np.int64)


@functools.cache
def vocabularies(a_path: str | None, b_path: str | None):
    """(A encoder, A bytes, B encoder, B bytes, identity map)."""
    a, (b, b_bytes) = encoding(a_path), _pieces(b_path)
    a_bytes = [b""] * (a.max_token_value + 1)
    for piece in a.token_byte_values():
        a_bytes[a.encode_single_token(piece)] = piece
    plain = [not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i)) for i in range(len(b_bytes))]
    return a.encode_ordinary, a_bytes, b.encode, b_bytes, identity_map(a_bytes, b_bytes, plain)


def cut(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, A places, B places) of two token sequences over the same bytes.

    Ends are the bytes up to which tokens of both end. The places are the links, in order: what
    lies between two neighbouring ends of any tokens is shared by just one A and one B token.
    """
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    every = np.sort(np.concatenate((a_end, b_end)), kind="stable")
    both = np.append(every[1:] == every[:-1], False)
    ends, every = every[both], every[~both]
    return ends, np.searchsorted(a_end, every), np.searchsorted(b_end, every)


class Lexicon:
    """Words, or whole texts, with their ids, groups and links."""

    def __init__(self, a_path: str | None, b_path: str | None):
        self.a_encode, self.a_bytes, self.b_encode, self.b_bytes, self.same = vocabularies(a_path, b_path)
        self.a_size = np.array([len(piece) for piece in self.a_bytes])
        self.b_size = np.array([len(piece) for piece in self.b_bytes])
        # How ids are spelled: A ids before a comma, a bar; B ids before a comma, a semicolon.
        counts = (len(self.a_bytes), len(self.a_bytes), len(self.b_bytes), len(self.b_bytes))
        spelled = [b"%d%c" % (i, mark) for n, mark in zip(counts, b",|,;") for i in range(n)]
        self.spelled = np.array(spelled, object)
        self.first_spelled = np.cumsum((0, *counts[:-1]))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # none: the bytes change
        self.totals = np.empty((0, 4), np.int64)  # per word: A tokens, B tokens, groups, links
        self.own, self.own_end = np.empty(0, np.uint16), np.zeros(1, np.int64)
        self.pairs, self.pairs_end = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.groups) > REMEMBERED or len(self.pairs) + len(self.own) > 8 * REMEMBERED

    def add(self, words: list[str]) -> None:
        """Encodes those not known yet, many words at once as if they were a text."""
        new = [word for word in words if word not in self.number]
        whole = [word for word in new if " " in word or _ODD_SPACE.search(word)]
        short = [word for word in new if not (" " in word or _ODD_SPACE.search(word))]
        parts = [self._part([text]) for text in whole]
        for start in range(0, len(short), ENCODED_WORDS):
            parts.extend(self._parts(short[start : start + ENCODED_WORDS]))
        for word in whole + short:
            self.number[word] = len(self.number)
        if not parts:
            return
        groups, totals, own, own_n, pairs, pairs_n = zip(*parts)
        self.groups.extend(text for texts in groups for text in texts)
        self.totals = np.concatenate((self.totals, *totals))
        self.own, self.pairs = np.concatenate((self.own, *own)), np.concatenate((self.pairs, *pairs))
        self.own_end = np.append(self.own_end, self.own_end[-1] + np.cumsum(np.concatenate(own_n)))
        self.pairs_end = np.append(self.pairs_end, self.pairs_end[-1] + np.cumsum(np.concatenate(pairs_n)))

    def _parts(self, words: list[str]) -> Iterator[tuple]:
        """The words' part; if bytes change, the halves', down to the word that they change in."""
        part = self._part(words)
        if part[0][0] is not None or len(words) == 1:
            yield part
        else:
            half = len(words) // 2
            yield from self._parts(words[:half])
            yield from self._parts(words[half:])

    def _part(self, words: list[str]) -> tuple:
        """(group texts, totals, own ids, their numbers by word, pairs, their numbers by word)."""
        text = " ".join(words)
        a = np.array(self.a_encode(" " + text), np.int64)
        b = np.array(self.b_encode(text), np.int64)
        data, n = (" " + text).encode(), len(words)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            nothing = np.zeros(n, np.int64)
            return [None] * n, np.zeros((n, 4), np.int64), np.empty(0, np.uint16), nothing, np.empty(0, np.uint32), nothing
        ends, i, j = cut(self.a_size[a], self.b_size[b])
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        word_end = np.cumsum([len(word.encode()) + 1 for word in words])
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        # The spelling: a group's A ids, then its B ids.
        code = np.concatenate(
            (
                self.first_spelled[np.append(a_group[1:] != a_group[:-1], True).astype(int)] + a,
                self.first_spelled[2 + np.append(b_group[1:] != b_group[:-1], True).astype(int)] + b,
            )
        )
        group = np.concatenate((a_group, b_group))
        turn = np.argsort(2 * group + np.repeat((0, 1), (len(a), len(b))), kind="stable")
        texts = self.spelled[code[turn]].tolist()
        group_word = np.searchsorted(word_end, ends)
        text_end = np.searchsorted(group_word[group[turn]], np.arange(n), side="right").tolist()
        groups = [b"".join(texts[start:stop]) for start, stop in zip([0, *text_end], text_end)]

        word = np.searchsorted(word_end, a_end[i])
        totals = [
            np.bincount(owner, minlength=n)
            for owner in (np.searchsorted(word_end, a_end), np.searchsorted(word_end, b_end), group_word, word)
        ]
        alike = self.same[a[i]] == b[j]
        pairs = a[i[~alike]] << 16 | b[j[~alike]]
        return (
            groups,
            np.stack(totals, axis=1),
            a[i[alike]].astype(np.uint16),
            np.bincount(word[alike], minlength=n),
            pairs.astype(np.uint32),
            np.bincount(word[~alike], minlength=n),
        )

    def split(self, text: str) -> list[str]:
        """What a text is encoded by: its words, or itself."""
        return [text] if _ODD_SPACE.search(text) else text.split(" ")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their added counts."""
    if not len(keys):
        return keys, counts
    turn = np.argsort(keys, kind="stable")
    keys = keys[turn]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.add.reduceat(counts[turn], start)


def _listed(row: np.ndarray, word: np.ndarray, count: np.ndarray, values: np.ndarray, end: np.ndarray, rows: int):
    """Per row, the distinct values of its words and their numbers, as bytes."""
    size = (end[1:] - end[:-1])[word]
    total = int(size.sum())
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(end[word], size)
    value = values[at].astype(np.int64)
    keys, counts = _summed(np.repeat(row, size) << 32 | value, np.repeat(count, size))
    bounds = np.searchsorted(keys >> 32, np.arange(rows + 1))
    distinct, counts = (keys & 0xFFFFFFFF).astype(values.dtype), counts.astype(np.uint32)
    cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return [distinct[a:b].tobytes() for a, b in cuts], [counts[a:b].tobytes() for a, b in cuts]


_LINKED = (
    "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "own binary, own_n binary, pairs binary, pairs_n binary"
)


def linked(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """(doc_id, block, n_a, n_b, n_groups, n_links, groups_sha256, groups, own, own_n, pairs, pairs_n) per row.

    ``groups`` spells the groups, on demand. ``own`` are the A ids linked by the identity map,
    as 16-bit numbers, ``pairs`` the other linked pairs, A id times 2**16 plus B id, as 32-bit
    numbers; both distinct, with their numbers of links.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = np.array([len(text.as_py() or "") for text in batch.column("text")], np.int64)
            start = 0
            while start < batch.num_rows:
                fits = np.searchsorted(np.cumsum(lengths[start : start + BLOCK_ROWS]), BLOCK_CHARS, side="right")
                stop = start + max(1, int(fits))
                yield part(lexicon, batch.slice(start, stop - start), block)
                block, start = block + 1, stop

    def part(lexicon: Lexicon, batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
        if lexicon.full():
            lexicon.forget()
        rows = batch.num_rows
        split = [lexicon.split(text) if text else [] for text in batch.column("text").to_pylist()]
        lexicon.add(list(dict.fromkeys(word for words in split for word in words)))
        numbers = [list(map(lexicon.number.__getitem__, words)) for words in split]
        digests, spelled = [], []
        for row, own in enumerate(numbers):
            texts = [lexicon.groups[i] for i in own]
            if None in texts:
                numbers[row], texts = [], []
            joined = b"".join(texts)[:-1]
            digests.append(hashlib.sha256(joined).hexdigest() if texts else "")
            spelled.append(joined.decode() if with_groups else None)
        row = np.repeat(np.arange(rows), [len(own) for own in numbers])
        flat = np.fromiter((i for own in numbers for i in own), np.int64, len(row))
        keys, count = _summed(row << 32 | flat, np.ones(len(row), np.int64))
        row, word = keys >> 32, keys & 0xFFFFFFFF
        totals = np.zeros((rows, 4), np.int64)
        np.add.at(totals, row, lexicon.totals[word] * count[:, None])
        own, own_n = _listed(row, word, count, lexicon.own, lexicon.own_end, rows)
        pairs, pairs_n = _listed(row, word, count, lexicon.pairs, lexicon.pairs_end, rows)
        columns = [
            batch.column("doc_id"),
            pa.array(np.full(rows, block)),
            *(pa.array(totals[:, i].copy()) for i in range(4)),
            pa.array(digests, pa.string()),
            pa.array(spelled, pa.string()),
            *(pa.array(values, pa.binary()) for values in (own, own_n, pairs, pairs_n)),
        ]
        names = ["doc_id", "block", *(field.split()[0] for field in _LINKED.split(", "))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(link, f"doc_id {kind}, block long, {_LINKED}")


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def own_counts(links: DataFrame, size: int) -> DataFrame:
    """(a, n): documents that link an A id by the identity map; each task adds up one vector."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column("own"), np.uint16), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["a", "n"])

    return links.select("own").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def block_counts(links: DataFrame) -> DataFrame:
    """(block, pair, n): documents of a block that hold a pair outside the identity map."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            bounds = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else []
            for start, stop in zip(bounds, bounds[1:]):
                pair, n = np.unique(_joined(batch.column("pairs").slice(start, stop - start), np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), block[start])), pa.array(pair.astype(np.int64)), pa.array(n)],
                    names=["block", "pair", "n"],
                )

    return links.select("block", "pairs").mapInArrow(count, "block long, pair long, n long")


def _counted(links: DataFrame, size: int) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """(pairs of blocks, counts of pairs, counts by the identity map, highest count of every A id).

    The two vectors have the vocabulary's length.
    """
    blocks = stored(block_counts(links), "block-pairs")
    pairs = stored(blocks.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    own, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row in own_counts(links, size).collect():
        own[row["a"]] = row["n"]
    for row in pairs.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("n")).collect():
        best[row["a"]] = row["n"]
    return blocks, pairs, own, np.maximum(own, best)


def pair_counts(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a, b, documents): every linked pair of ids and how many documents hold it linked."""
    same = vocabularies(a_path, b_path)[4]
    links = stored(linked(documents, a_path, b_path), "links")
    _, pairs, own, _ = _counted(links, len(same))
    held = [(int(a), int(same[a]), int(own[a])) for a in np.flatnonzero(own)]
    identical = documents.sparkSession.createDataFrame(held, "a long, b long, documents long")
    others = pairs.select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), F.col("n"))
    return others.union(identical).toDF("a", "b", "documents")


def report(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The query's columns: sizes of every document's alignment, and its links' counts."""
    size = len(vocabularies(a_path, b_path)[4])
    links = stored(linked(documents.select(F.col("doc_id").cast("long"), "text"), a_path, b_path), "links")
    blocks, pairs, own_count, best = _counted(links, size)
    known = blocks.select("block", "pair").join(pairs, "pair")

    def add_up(rows: pa.Table, own_pairs: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        pair, n = (own_pairs.column(name).to_numpy() for name in ("pair", "n"))
        turn = np.argsort(pair)
        pair, n = pair[turn], n[turn]
        total = np.zeros((rows.num_rows, 2), np.int64)

        def add(ids: str, numbers: str, kind: type, lookup) -> None:
            values = rows.column(ids).to_pylist()
            owner = np.repeat(np.arange(len(values)), [len(v) // np.dtype(kind).itemsize for v in values])
            found, highest = lookup(np.frombuffer(b"".join(values), kind).astype(np.int64))
            times = _joined(rows.column(numbers), np.uint32).astype(np.int64)
            np.add.at(total, owner, np.stack((times * (found == highest), times * found), axis=1))

        add("own", "own_n", np.uint16, lambda a: (own_count[a], best[a]))
        add("pairs", "pairs_n", np.uint32, lambda p: (n[np.searchsorted(pair, p)], best[p >> 16]))
        sizes = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        columns = [*sizes.columns, pa.array(total[:, 0].copy()), pa.array(total[:, 1].copy()), rows.column("groups_sha256")]
        return pa.Table.from_arrays(columns, names=[*sizes.column_names, "n_best", "count_sum", "groups_sha256"])

    return (
        links.drop("groups")
        .groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(
            add_up,
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
        )
    )
