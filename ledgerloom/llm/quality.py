"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text are the frequencies of its hashed words, statistics of its structure
(repetition, letter case, symbols, lines) and its length class as metadata; further
metadata columns can be named and are hashed like words. All pairs of features interact
through low-rank factors; the sum over pairs is half the square of the sum less the sum of
the squares, so a score takes time linear in the features.

The model is trained on a bounded sample (``PER_CLASS`` documents of each label) whose
features, not texts, reach the driver. Scoring is one pass over the documents without a
shuffle; the model is a few hundred kilobytes.

Defined cases: a null text scores like an empty one, and empty texts get the score of a
text without words; a null doc_id is never held out and never trained on; repeated rows
score alike, one result each; with no usable label of a class every score is that of the
only class known, or 0.5 without any label; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.learning import held_out, labelled_sample
from ledgerloom.llm.shingling import U64, mix, word_hashes

MODULUS, REMAINDER = 4, 2
PER_CLASS = 3000
BUCKETS = 2048
RANK = 6
THRESHOLD = 0.7
_STATISTICS = 22
_LENGTHS = 24

_LETTER_UPPER = np.zeros(256, bool)
_LETTER_UPPER[65:91] = True
_LETTER_LOWER = np.zeros(256, bool)
_LETTER_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PROSE_MARK = np.zeros(256, bool)
_PROSE_MARK[[ord(c) for c in ".,;:'\"()?-"]] = True


def statistics(text: bytes, words: np.ndarray) -> np.ndarray:
    """Ratios that describe structure, each within about 0 to 1."""
    out = np.zeros(_STATISTICS, np.float32)
    if not len(words):
        out[0] = 1
        return out
    size, n = len(text), len(words)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit = count[_LETTER_UPPER].sum(), count[_LETTER_LOWER].sum(), count[_DIGIT].sum()
    blank, mark, other = count[_BLANK].sum(), count[_PROSE_MARK].sum(), count[128:].sum()
    symbols = size - upper - lower - digit - blank - mark - other
    pairs = mix(words[:-1] * U64(3) + words[1:])
    triples = mix(pairs[:-1] * U64(3) + words[2:]) if n > 2 else words[:0]
    counts = np.sort(np.unique(words, return_counts=True)[1])
    lines = text.split(b"\n")
    filled = [line for line in lines if line.strip()]
    out[1] = min(1, (size - blank) / n / 16)
    out[2] = upper / max(1, upper + lower)
    out[3] = digit / size
    out[4] = symbols / size
    out[5] = min(1, 4 * symbols / n)
    out[6] = mark / size
    out[7] = other / size
    out[8] = blank / size
    out[9] = len(counts) / n
    out[10] = (words[1:] == words[:-1]).mean() if n > 1 else 0
    out[11] = len(np.unique(pairs)) / (n - 1) if n > 1 else 1
    out[12] = len(np.unique(triples)) / (n - 2) if n > 2 else 1
    out[13] = counts[-1] / n
    out[14] = counts[-5:].sum() / n
    out[15] = min(1, n / max(1, len(filled)) / 64)
    out[16] = len(set(filled)) / max(1, len(filled))
    out[17] = count[ord("|")] / n
    out[18] = count[ord("!")] / n
    out[19] = (count[ord("*")] + count[ord("#")] + count[ord("%")] + count[ord("$")] + count[ord("&")]) / n
    out[20] = text.count(b". ") / n
    out[21] = min(1, n / 20)
    return out


def _vector(text: bytes | None, extra: list[str]) -> np.ndarray:
    """All features of one text."""
    text = text or b""
    words = word_hashes(text)
    hashed = np.bincount((words & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.float32)
    for value in extra:
        hashed[zlib.crc32(value.encode()) % BUCKETS] += 1
    norm = float(np.sqrt((hashed * hashed).sum()))
    if norm:
        hashed /= norm
    length = np.zeros(_LENGTHS, np.float32)
    length[min(_LENGTHS - 1, len(text).bit_length())] = 1
    return np.concatenate([hashed, statistics(text, words), length])


@dataclass
class Machine:
    """w0 + w.x + the interactions of all pairs, as a logit; inputs are scaled first."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.center) * self.scale
        together = x @ self.factors
        alone = (x * x) @ (self.factors * self.factors)
        return self.bias + x @ self.weights + 0.5 * ((together * together).sum(axis=1) - alone.sum(axis=1))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features).astype(np.float64), -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, importance: np.ndarray, epochs: int = 12, seed: int = 5) -> Machine:
    """Minimise the weighted logistic loss by Adam over shuffled batches."""
    random = np.random.default_rng(seed)
    width = BUCKETS + _STATISTICS + _LENGTHS
    center, scale = np.zeros(width, np.float32), np.ones(width, np.float32)
    known = float((importance * labels).sum() / importance.sum()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        bias = 0.0 if not len(labels) else float(np.log((known + 1e-6) / (1 - known + 1e-6)))
        return Machine(bias, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), center, scale)
    part = slice(BUCKETS, BUCKETS + _STATISTICS)
    center[part] = features[:, part].mean(axis=0)
    scale[part] = 1 / np.maximum(features[:, part].std(axis=0), 0.05)
    scale[part] = np.minimum(scale[part], 8)
    x_all = (features - center) * scale
    state = {
        "bias": np.array([np.log(known / (1 - known))], np.float32),
        "weights": np.zeros(width, np.float32),
        "factors": random.normal(0, 0.02, (width, RANK)).astype(np.float32),
    }
    decay = {"bias": 0.0, "weights": 1e-4, "factors": 1e-3}
    first = {name: np.zeros_like(value) for name, value in state.items()}
    second = {name: np.zeros_like(value) for name, value in state.items()}
    step, batch = 0, 64
    for epoch in range(epochs):
        order = random.permutation(len(labels))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            x, y, weight = x_all[chosen], labels[chosen], importance[chosen]
            together = x @ state["factors"]
            squares = x * x
            logits = state["bias"][0] + x @ state["weights"]
            logits = logits + 0.5 * ((together**2).sum(1) - (squares @ (state["factors"] ** 2)).sum(1))
            slope = (weight * (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y) / weight.sum()).astype(np.float32)
            gradients = {
                "bias": np.array([slope.sum()], np.float32),
                "weights": x.T @ slope,
                "factors": x.T @ (slope[:, None] * together) - (squares.T @ slope)[:, None] * state["factors"],
            }
            step += 1
            for name, gradient in gradients.items():
                gradient = gradient + decay[name] * state[name]
                first[name] = 0.9 * first[name] + 0.1 * gradient
                second[name] = 0.999 * second[name] + 0.001 * gradient * gradient
                lead = first[name] / (1 - 0.9**step)
                state[name] = state[name] - rate * lead / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(state["bias"][0]), state["weights"], state["factors"], center, scale)


def _featured(texts: DataFrame, metadata: tuple[str, ...]) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [vector.astype(np.float16).tobytes() for vector in _vectors(batch, metadata)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], names=["label", "x"])

    return texts.select("label", "text", *metadata).mapInArrow(build, "label int, x binary")


def _vectors(batch: pa.RecordBatch, metadata: tuple[str, ...]) -> Iterator[np.ndarray]:
    others = [batch.column(name).to_pylist() for name in metadata]
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        yield _vector(text.as_py(), [f"{name}={column[i]}" for name, column in zip(metadata, others)])


def train(
    documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, metadata: tuple[str, ...] = ()
) -> Machine:
    """A machine for ``labels.quality``; held-out documents take no part.

    It is for scores with the same ``metadata`` columns.
    """
    sample, sizes = labelled_sample(documents, labels, "quality", MODULUS, REMAINDER, per_class, metadata)
    rows = _featured(sample, metadata).toArrow()
    y = rows.column("label").to_numpy().astype(np.float32)
    width = BUCKETS + _STATISTICS + _LENGTHS
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).astype(np.float32).reshape(len(y), width)
    order = np.lexsort((x @ np.arange(width, dtype=np.float32), y))  # rows arrive in any order
    x, y = x[order], y[order]
    drawn = {value: max(1, int((y == value).sum())) for value in (0, 1)}
    importance = np.array([sizes[int(value)] / drawn[int(value)] for value in y], np.float32)
    return fit(x, y, importance / importance.mean() if len(importance) else importance)


def score(documents: DataFrame, machine: Machine, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, quality_score) per row: the probability of label 1."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _scores(batch, machine, metadata)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "quality_score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", *metadata).mapInArrow(apply, f"doc_id {kind}, quality_score double")


def _scores(batch: pa.RecordBatch, machine: Machine, metadata: tuple[str, ...]) -> np.ndarray:
    scores, held = [np.empty(0)], []
    for vector in _vectors(batch, metadata):
        held.append(vector)
        if len(held) == 256:
            scores.append(machine.scores(np.stack(held)))
            held = []
    if held:
        scores.append(machine.scores(np.stack(held)))
    return np.concatenate(scores)


def keep_good(
    documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, metadata: tuple[str, ...] = ()
) -> DataFrame:
    """The rows, all columns, whose score reaches the threshold."""
    machine = train(documents, labels, metadata=metadata)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, machine, metadata) >= threshold))

    return documents.mapInArrow(choose, documents.schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
