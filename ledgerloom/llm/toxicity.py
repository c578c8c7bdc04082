"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares two words by their common subsequences of three characters (word ends
count as characters), each weighted less the more it is gapped, so that ``idxiot`` stays
near ``idiot``. Its exact feature map, hashed, is normalised; a Gaussian of the distance
there makes it local. Characters that are no letters or digits are dropped before, and
runs of single characters are joined, so ``i.d-i o t`` is ``idiot`` too.

Training: the words of the sentences of a bounded sample of labelled documents
(``PER_CLASS`` ids per label) are counted by label in Spark; words almost only found in
toxic documents are the positive examples. Landmarks are the strongest of them, the clean
words most like them, and common clean words. The machine is a linear one on the Nyström
features, and a document scores as its most toxic word, calibrated to a probability.

Scoring is one pass without a shuffle over whole texts; a task scores each distinct word
once and remembers a bounded number of words, which changes its speed only.

Defined cases: null and blank texts score like a text whose words are all unlike any
landmark; a null doc_id is never held out and never trained on; repeated rows score alike,
one result each; without any toxic word to learn from every score is the share of toxic
documents among the labelled (0 without labels); empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.learning import held_out, labelled_sample
from ledgerloom.llm.shared import stored

MODULUS, REMAINDER = 3, 1
PER_CLASS = 4000
THRESHOLD = 0.7

SPAN = 4  # a subsequence reaches over at most this many characters more than its first
DECAY = 0.75
SIGMA = 0.4  # of the wide Gaussian; the narrow one is its fourth power
PENALTY = 1.0
BUCKETS = 1024
WIDTH = 24  # longer words are cut into overlapping pieces of this length
TOXIC_LANDMARKS, NEAR_LANDMARKS, COMMON_LANDMARKS = 96, 64, 8
DISGUISED = 16  # so many of the strongest words are also learned with a character inserted
REMEMBERED = 300_000

_DROPPED = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_](?:[^\w\n!?]|_){1,2}){2,}[^\W_](?![^\W_])")
_GAPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN + 1) for a in range(1, b)]


def unit(word: str) -> str:
    """The letters and digits of a word, in lower case."""
    return _DROPPED.sub("", word.lower())


def raw_words(text: str | None) -> set[str]:
    """Distinct words of a whole text as written, and its runs of spelled-out characters."""
    if not text:
        return set()
    words = set(text.split())
    words.update(_SPELLED.findall(text))
    return words


def units(text: str | None) -> set[str]:
    """The same as letters and digits only."""
    found = {unit(word) for word in raw_words(text)}
    found.discard("")
    return found


def _pieces(word: str) -> list[str]:
    marked = f"\x02{word}\x03"
    if len(marked) <= WIDTH:
        return [marked]
    return list(dict.fromkeys(marked[at : at + WIDTH] for at in range(0, len(marked) - WIDTH // 2, WIDTH // 2)))


def feature_map(pieces: list[str]) -> np.ndarray:
    """Normalised weights of the gapped subsequences of each piece, in hashed buckets."""
    codes = np.frombuffer("".join([p.ljust(WIDTH, "\0") for p in pieces]).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes.reshape(len(pieces), WIDTH)
    codes = codes[:, : int((codes > 0).sum(axis=1).max())]
    width = codes.shape[1]
    # Shorter pieces are padded with 0, which ends no subsequence.
    head, middle, tail = (codes * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    row = (np.arange(len(pieces)) * BUCKETS)[:, None]
    at, weights = [], []
    for a, b, weight in _GAPS:
        if b < width:
            key = head[:, : width - b] + middle[:, a : width - b + a] + tail[:, b:]
            bucket = ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - BUCKETS.bit_length())
            used = codes[:, b:] > 0
            at.append((row + bucket)[used])
            weights.append(np.full(len(at[-1]), weight))
    flat = np.bincount(np.concatenate(at), np.concatenate(weights), len(pieces) * BUCKETS) if at else np.zeros(len(pieces) * BUCKETS)
    out = flat.astype(np.float32).reshape(len(pieces), BUCKETS)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, np.float32(1e-6))[:, None]


def kernel(likeness: np.ndarray) -> np.ndarray:
    """A wide and a narrow Gaussian of the distance, from inner products of feature maps."""
    wide = np.exp((likeness - 1) * (1 / SIGMA))
    square = wide * wide
    return (wide + square * square) / 2


@dataclass
class Machine:
    """Landmarks with the weights the Nyström features get, and the calibration.

    ``evidence`` is the logarithm of the toxic documents that support a landmark.
    """

    landmarks: np.ndarray
    weights: np.ndarray
    bias: float
    evidence: np.ndarray
    slopes: tuple[float, float, float] = (0.0, 0.0, 0.0)
    offset: float = 0.0

    def margins(self, words: list[str]) -> list[tuple[float, float]]:
        """How toxic each word is, and the evidence behind the landmark it is most like.

        A long word counts as its worst piece.
        """
        if not words:
            return []
        pieces: list[str] = []
        first = []
        for word in words:
            first.append(len(pieces))
            pieces += _pieces(word)
        margin, evidence = [], []
        for at in range(0, len(pieces), 512):
            likeness = feature_map(pieces[at : at + 512]) @ self.landmarks.T
            near = kernel(likeness)
            margin.append(near @ self.weights + self.bias)
            evidence.append((near * self.evidence).max(axis=1))
        worst = [np.maximum.reduceat(np.concatenate(parts), first) for parts in (margin, evidence)]
        return list(zip(worst[0].clip(LOW, HIGH).tolist(), worst[1].tolist()))


LOW, HIGH = -1.5, 1.5


class Scorer:
    """What a document's probability rests on, for whole texts; remembers the words it has seen.

    That is the margins of its two most toxic words (a chance likeness weighs less than an
    insult among others) and the better evidence of the two.
    """

    def __init__(self, machine: Machine):
        self.machine = machine
        self.raw: dict[str, str] = {}
        self.known: dict[str, tuple[float, float]] = {"": (LOW, 0.0)}

    def traits(self, texts: list[str | None]) -> np.ndarray:
        """Rows (first, second, evidence); a word that is not there counts as LOW."""
        if len(self.raw) > REMEMBERED:
            self.raw, self.known = {}, {"": (LOW, 0.0)}
        raw, known = self.raw, self.known
        split = [raw_words(text) for text in texts]
        for words in split:
            for word in words.difference(raw):
                raw[word] = unit(word)
        forms = [{raw[word] for word in words} for words in split]
        new = list(set().union(*forms).difference(known))
        known.update(zip(new, self.machine.margins(new)))
        out = np.full((len(texts), 3), LOW)
        out[:, 2] = 0
        for i, words in enumerate(forms):
            ranked = heapq.nlargest(2, map(known.__getitem__, words))
            for place, (margin, evidence) in enumerate(ranked):
                out[i, place] = margin
                out[i, 2] = max(out[i, 2], evidence)
        return out


def _svm(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active examples."""
    x = np.hstack([features, np.ones((len(features), 1))])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        active = labels * (x @ w) < 1
        xa, wa = x[active], weights[active]
        new = np.linalg.solve(ridge + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ labels[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _inserted(word: str, fill: str = "") -> list[str]:
    """The word with one more character at each inner place: the fill, or the letter
    before it again and a letter that varies with the place."""
    out = []
    for at in range(1, len(word)):
        for extra in fill or word[at - 1] + "xaeziou"[at % 7]:
            out.append(word[:at] + extra + word[at:])
    return out


def _fit_words(counts: list[tuple[str, int, int]], support: int) -> Machine | None:
    """A machine from (word, toxic documents, clean documents) rows.

    Positive examples need that much support, in documents, and nine in ten of them toxic.
    """
    toxic = [row for row in counts if row[1] >= support and row[1] >= 9 * row[2]]
    clean = [row for row in counts if row[2] > 0 and row[1] <= row[2]]
    if not toxic or not clean:
        return None
    toxic.sort(key=lambda row: (-row[1], row[0]))
    clean.sort(key=lambda row: (-row[2], row[0]))
    toxic, clean = toxic[:1500], clean[:12000]
    maps = {row[0]: feature_map(_pieces(row[0])[:1])[0] for row in toxic}
    strong = list(maps)[:TOXIC_LANDMARKS]
    strong_maps = np.stack([maps[word] for word in strong])
    clean_maps = np.vstack([feature_map([_pieces(row[0])[0] for row in clean[at : at + 1024]]) for at in range(0, len(clean), 1024)])
    likeness = (clean_maps @ strong_maps.T).max(axis=1)
    near = np.argsort(-likeness, kind="stable")[:NEAR_LANDMARKS]
    plain = [row[0] for row in toxic[:DISGUISED] if 3 <= len(row[0]) <= 16]
    gapped = [variant for word in plain for variant in _inserted(word, "\x01")]
    support_of = {row[0]: row[1] for row in toxic}
    disguised = sorted({variant for word in plain for variant in _inserted(word)} - {row[0] for row in clean})
    for word in disguised:
        maps.setdefault(word, feature_map(_pieces(word)[:1])[0])
    gapped_maps = [feature_map(_pieces(word)[:1]) for word in gapped]
    landmarks = np.vstack([strong_maps, clean_maps[near], clean_maps[:COMMON_LANDMARKS], *gapped_maps]).astype(np.float64)
    evidence = np.zeros(len(landmarks))
    evidence[: len(strong)] = np.log1p([support_of[word] for word in strong])
    if gapped:
        evidence[-len(gapped) :] = np.log1p([support_of[word] for word in plain for _ in range(len(word) - 1)])
    landmarks, at = np.unique(landmarks, axis=0, return_index=True)
    evidence = evidence[at]
    values, vectors = np.linalg.eigh(kernel(landmarks @ landmarks.T))
    kept = values > 1e-6
    nystroem = vectors[:, kept] / np.sqrt(values[kept])
    positive = np.stack([maps[row[0]] for row in toxic] + [maps[word] for word in disguised])
    x = kernel(np.vstack([positive, clean_maps]) @ landmarks.T) @ nystroem
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(clean))])
    weight = np.array([row[1] for row in toxic] + [10] * len(disguised) + [row[2] for row in clean], float).clip(0, 50)
    w, bias = _svm(x, y, weight, PENALTY)
    return Machine(landmarks.astype(np.float32), (nystroem @ w).astype(np.float32), bias, evidence.astype(np.float32))


def _calibrated(machine: Machine, traits: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> Machine:
    """Logistic regression of the label on a document's traits."""
    x = np.column_stack([traits, np.ones(len(traits))])
    beta, ridge = np.zeros(4), np.array([1e-1, 1e-1, 1e-1, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (importance * (labels - p)) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return replace(machine, slopes=tuple(beta[:3].tolist()), offset=float(beta[3]))


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """A machine for ``labels.toxic``; held-out documents take no part."""
    texts, sizes = labelled_sample(documents, labels, "toxic", MODULUS, REMAINDER, per_class)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_pylist()
            for at, text in enumerate(batch.column("text").to_pylist()):
                words = sorted(word for word in units(text) if len(word) <= 4 * WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array([label[at]] * len(words), pa.int32())], names=["word", "label"]
                )

    sample = stored(texts.select("label", "text"), "toxicity-sample")
    counted = stored(
        sample.mapInArrow(split, "word string, label int")
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")),
        "toxicity-words",
    )
    drawn = sample.groupBy("label").agg(F.count("*").alias("n")).collect()
    counts = {row["label"]: row["n"] for row in drawn}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    # What trains the machine is bounded: the strongest words of either side.
    support = max(2, math.ceil(counts.get(1, 0) / 200))
    suspect = counted.where(f"toxic >= {support} AND toxic >= 9 * clean").orderBy(F.desc("toxic"), "word").limit(2000)
    common = counted.where("clean > 0 AND toxic <= clean").orderBy(F.desc("clean"), "word").limit(6000)
    rare = counted.where("clean > 0 AND toxic <= clean").orderBy(F.xxhash64("word"), "word").limit(6000)
    rows = {(r["word"], r["toxic"], r["clean"]) for r in suspect.union(common).union(rare).collect()}
    machine = _fit_words(sorted(rows), support)
    if machine is None:
        odds = math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0)
        nothing = np.zeros(1, np.float32)
        return Machine(np.zeros((1, BUCKETS), np.float32), nothing, 0.0, nothing, offset=odds)
    scored = traits(sample, machine, "label").toArrow()
    y = scored.column("label").to_numpy().astype(float)
    importance = np.array([sizes[int(v)] / counts[int(v)] for v in y])
    return _calibrated(machine, np.column_stack([scored.column(name).to_numpy() for name in TRAITS]), y, importance)


TRAITS = ("first", "second", "evidence")


def traits(rows: DataFrame, machine: Machine, name: str) -> DataFrame:
    """(that column, first, second, evidence) of each row's whole ``text``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for batch in batches:
            texts = batch.column("text")
            parts = [np.empty((0, 3))]
            for at in range(0, len(texts), 256):
                parts.append(scorer.traits(texts.slice(at, 256).to_pylist()))
            found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(name), *map(pa.array, found.T)], names=[name, *TRAITS])

    kind = rows.schema[name].dataType.simpleString()
    return rows.select(name, "text").mapInArrow(apply, f"{name} {kind}, first double, second double, evidence double")


def probability(machine: Machine) -> Column:
    """Of label 1, from the traits."""
    logit = F.lit(machine.offset)
    for slope, name in zip(machine.slopes, TRAITS):
        logit = logit + F.lit(slope) * F.col(name)
    return 1 / (1 + F.exp(-logit))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    machine = train(documents, labels)
    scored = traits(documents.select("doc_id", "text"), machine, "doc_id").withColumn("score", probability(machine))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
