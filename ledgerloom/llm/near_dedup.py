"""Near-duplicate groups: MinHash signatures, banding, verified links, connected components.

1. Every document becomes its set of distinct word shingles and, of it, a signature of
   many universal hash minima. Rows with the same set are one class under a number of its
   own, whatever doc_ids they have; its text is read from the row with the smallest one.
2. Signatures are cut into bands; classes that agree in a whole band share a bucket. The
   number of bands follows from the threshold: a linked pair shares no bucket with a
   probability of at most ``MISS``.
3. In each bucket the members are compared with its smallest one: signatures first, then
   the full sets. The links give first components.
4. A bucket that holds several components may hide more links. There, and only there,
   members of different components are compared block by block, within tasks; a block emits
   no more links than it takes to join what it found. Large components become more blocks,
   never larger ones, and blocks of one component do not meet.
5. Components are taken again over all links, by alternating large-star and small-star;
   the smallest doc_id of each is looked up at the end.

Defined cases: null and blank texts have no shingles, link with nothing and stay; rows
without a doc_id link like others, and a component without any doc_id is null; repeated rows
and rows that share a doc_id give one result each; rows with one doc_id and different texts
are different documents; an empty table gives no rows. Columns other than doc_id
and text are ignored; ``drop_duplicates`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import broadcast_up_to, stored, text_key
from ledgerloom.llm.shingling import U64, mix, shingle_set

WORDS = 5
PERCENT = 80
ROWS = 5
MISS = 1e-7
# Members per block: of signatures (some 150 bytes each), and of full sets, of which those
# with more than SET_SHINGLES / SET_BLOCK shingles (8 bytes each) count as several.
SIGNATURE_BLOCK = 1024
SET_BLOCK, SET_SHINGLES = 512, 2_000_000

# Two longs each: up to about 50 MB as a hash table.
BROADCAST_REPS = 1_000_000

_SIGNED = "doc_id long, text_key long, n_shingles long, set_key long, set_check long, signature binary, bands array<long>"


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands after which a pair at the threshold is missed with at most that probability."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))))


class Signer:
    """Signature and band keys of a shingle set: minima of multiply-shift hash functions."""

    def __init__(self, bands: int, rows: int = ROWS):
        random = np.random.default_rng(17)
        self.bands, self.rows, size = bands, rows, bands * rows
        self.factor = random.integers(0, 2**63, size, dtype=U64) * U64(2) + U64(1)
        self.shift = random.integers(0, 2**63, size, dtype=U64)
        self.step = random.integers(0, 2**63, rows, dtype=U64) * U64(2) + U64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), 2**64 - 1, dtype=U64)
        for at in range(0, len(shingles), 4096):  # bounds the matrix for very long texts
            hashed = shingles[at : at + 4096] * self.factor[:, None] + self.shift[:, None]
            np.minimum(least, hashed.min(axis=1), out=least)
        return least >> U64(32)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        banded = (minima.reshape(self.bands, self.rows) * self.step).sum(axis=1, dtype=U64)
        return mix(banded + np.arange(self.bands, dtype=U64)).view(np.int64)


def signed(documents: DataFrame, words: int, bands: int) -> DataFrame:
    """One row per document row: size and identity of its set, signature, band keys.

    A signature keeps eight bits per minimum; it only serves to estimate.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands)
        for batch in batches:
            sizes, keys, checks, signatures, banded = [], [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                keys.append(int(shingles.sum(dtype=U64).view(np.int64)))
                checks.append(int(mix(shingles ^ U64(0x5BD1E9955BD1E995)).sum(dtype=U64).view(np.int64)))
                minima = signer.minima(shingles)
                signatures.append(minima.astype(np.uint8).tobytes())
                banded.append(signer.keys(minima).tolist() if len(shingles) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(checks, pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array(banded, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_key", "set_check", "signature", "bands"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(sign, _SIGNED)


def _sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles): the full sets, as bytes, of the wanted (rep, doc_id, text_key).

    The texts are read again rather than kept; up to a bound the wanted rows are broadcast,
    so that no text is shuffled.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sets = [shingle_set(text.as_py(), words).tobytes() for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    side = broadcast_up_to(wanted.toDF("rep", "_doc_id", "_text_key"), BROADCAST_REPS)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    chosen = texts.join(side, same).select("rep", "text")
    return chosen.mapInArrow(build, "rep long, shingles binary").dropDuplicates(["rep"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = [
                _linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent)
                for x, y in zip(left, right)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long")


def _resembling(pairs: DataFrame, signatures: DataFrame, floor: float) -> DataFrame:
    """The pairs whose signatures agree in that share of places."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (_matrix(batch.column(c)) for c in ("left", "right"))
                keep = (left == right).mean(axis=1) >= floor
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = signatures.select(F.col("rep").alias("a"), F.col("signature").alias("left"))
    right = signatures.select(F.col("rep").alias("b"), F.col("signature").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(len(signatures), -1)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            if held and any(held[-1].column(key)[0] != part.column(key)[0] for key in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Members (bucket, rep, label, weight) with their payload, dealt to pairs of blocks of their bucket.

    A label with a block's weight or more is cut into blocks of its own; the smaller labels of
    a bucket share blocks, each label whole in one. Two blocks meet unless they hold
    the same single label, so members of one component are not dealt against each other. Rows
    are sorted so that one (bucket, pair) lies together in its partition.
    """
    size = F.ceil(F.sum("weight")).cast("int")
    sizes = members.groupBy("bucket", "label").agg(F.sum("weight").alias("weight"))
    large = sizes.where("weight >= 1").groupBy("bucket", "label").agg(size.alias("blocks"))
    small = sizes.where("weight < 1").groupBy("bucket").agg(size.alias("blocks"))

    own = members.join(large, ["bucket", "label"], "left").join(small.withColumnRenamed("blocks", "shared"), "bucket", "left")
    own = own.select(
        "bucket",
        F.when(F.col("blocks").isNotNull(), F.col("label")).alias("owner"),
        F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("rep"), "blocks"))
        .otherwise(F.pmod(F.xxhash64("label"), "shared"))
        .cast("int")
        .alias("block"),
        "rep",
        "label",
    )

    def numbers(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    nobody = F.lit(None).cast("long")
    inside = (
        small.select("bucket", "blocks", numbers("blocks").alias("block"))
        .select("*", numbers("blocks").alias("other"))
        .where("block <= other")
        .select("bucket", nobody.alias("owner"), "block", nobody.alias("other_owner"), "other")
    )
    across = small.toDF("bucket", "shared").join(large, "bucket")
    across = across.select("*", numbers("shared").alias("block")).select(
        "bucket", nobody.alias("owner"), "block", F.col("label").alias("other_owner"), numbers("blocks").alias("other")
    )
    apart = large.join(large.toDF("bucket", "other_owner", "other_blocks"), "bucket").where("label < other_owner")
    apart = apart.select("*", numbers("blocks").alias("block")).select(
        "bucket", F.col("label").alias("owner"), "block", "other_owner", numbers("other_blocks").alias("other")
    )
    pairs = inside.union(across).union(apart)
    pair = F.xxhash64("bucket", F.coalesce("owner", F.lit(-1)), "block", F.coalesce("other_owner", F.lit(-1)), "other")
    numbered = pairs.withColumn("pair", pair)
    places = numbered.select("bucket", "owner", "block", "pair").union(
        numbered.select("bucket", "other_owner", "other", "pair").where("NOT (owner <=> other_owner AND block = other)")
    )
    places = places.toDF("bucket", "_owner", "_block", "pair")
    met = (own["owner"].eqNullSafe(places["_owner"])) & (own["block"] == places["_block"]) & (own["bucket"] == places["bucket"])
    dealt = own.join(places, met).select(own["bucket"], "pair", "rep", "label")
    keys = ["bucket", "pair"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.join(payload, "rep").repartition(parts, *keys).sortWithinPartitions(*keys, "label")


def _suspects(members: DataFrame, signatures: DataFrame, floor: float) -> DataFrame:
    """(bucket, rep) of members whose signature resembles one of another component there."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["bucket", "pair"]):
            labels = group.column("label").to_numpy()
            if labels[0] == labels[-1]:
                continue
            matrix = _matrix(group.column("signature").combine_chunks())
            near = np.zeros(len(labels), dtype=bool)
            for i, end in enumerate(np.searchsorted(labels, labels, side="right")):
                # Labels lie together; a row is compared with those of the labels after its own.
                hit = (matrix[end:] == matrix[i]).mean(axis=1) >= floor
                near[end:] |= hit
                near[i] |= hit.any()
            if near.any():
                yield group.select(["bucket", "rep"]).filter(pa.array(near)).combine_chunks().to_batches()[0]

    return _blocks(members, signatures).mapInArrow(compare, "bucket long, rep long").distinct()


def common_counts(sets: list[np.ndarray], width: int = 16384) -> np.ndarray:
    """Sizes of all intersections, by multiplying incidence matrices a slab at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        slab = np.zeros((len(sets), width), dtype=np.float32)
        slab[owner[low:high], column[low:high] - start] = 1
        total += slab @ slab.T
    return total.astype(np.int64)


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) by full sets between different components of a bucket, as many as join them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["bucket", "pair"]):
            labels = group.column("label").to_numpy()
            if labels[0] == labels[-1]:
                continue
            reps = group.column("rep").to_numpy()
            shingles = [np.frombuffer(s.as_buffer(), U64) for s in group.column("shingles").combine_chunks()]
            size = np.array([len(s) for s in shingles])
            common = common_counts(shingles)
            linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
            top = {label: label for label in labels.tolist()}

            def find(label):
                while top[label] != label:
                    top[label] = top[top[label]]
                    label = top[label]
                return label

            left, right = [], []
            for i, j in zip(*np.nonzero(np.triu(linked & (labels[:, None] != labels[None, :]), 1))):
                x, y = find(int(labels[i])), find(int(labels[j]))
                if x != y:
                    top[x] = y
                    left.append(int(reps[i]))
                    right.append(int(reps[j]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return _blocks(members, sets).mapInArrow(compare, "a long, b long").distinct()


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, rep, label) of buckets with several components; one of buckets with the same members."""
    labelled = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("label", "rep").alias("label")
    )
    several = labelled.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    )
    once = several.where("low <> high").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    return labelled.join(once.select("bucket"), "bucket", "left_semi")


def groups(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, component) per document row.

    Two documents are linked if their shingle sets' intersection is at least ``percent``
    hundredths of their union; ``component_id`` is the smallest doc_id reachable.
    ``component`` numbers the components, also those that share a doc_id or have none.
    """
    bands = band_count(percent)
    similarity = percent / 100
    # Estimates scatter by this much at the threshold; five times it loses no link.
    floor = similarity - 5 * math.sqrt(similarity * (1 - similarity) / (bands * ROWS))
    rows = stored(signed(documents, words, bands), "signed")
    identity = ["n_shingles", "set_key", "set_check"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("least")
    classes = stored(
        rows.where("n_shingles > 0")
        .groupBy(*identity)
        .agg(least)
        .select(*identity, "least.doc_id", "least.text_key", F.monotonically_increasing_id().alias("rep")),
        "classes",
    )
    source = classes.select(*identity, F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "rep")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    for name in identity:
        same &= rows[name] == source[name]
    chosen = rows.join(source, same).select("rep", "signature", "bands").dropDuplicates(["rep"])

    banded = chosen.select("rep", F.explode("bands").alias("bucket"))
    centers = banded.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1")
    shared = stored(banded.join(centers, "bucket").select("bucket", "rep", "center"), "buckets")
    sharing = classes.select("rep", "doc_id", "text_key", "n_shingles").join(shared, "rep", "left_semi")
    sharing = stored(sharing, "sharing")
    signatures = stored(chosen.select("rep", "signature").join(sharing, "rep", "left_semi"), "signatures")
    sets = stored(_sets(documents, sharing.drop("n_shingles"), words), "sets")

    pairs = shared.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    near = _resembling(pairs, signatures, floor)
    star = stored(_confirmed(near, sets, percent), "links")
    labels = components(star.toDF("u", "v"))

    mixed = stored(_mixed(shared.select("bucket", "rep"), labels), "mixed")
    suspects = _suspects(mixed.withColumn("weight", F.lit(1 / SIGNATURE_BLOCK)), signatures, floor)
    rest = mixed.join(stored(suspects, "suspects"), ["bucket", "rep"], "left_semi")
    weight = F.greatest(F.lit(1 / SET_BLOCK), F.col("n_shingles") / F.lit(SET_SHINGLES)).alias("weight")
    more = _links(rest.join(sharing.select("rep", weight), "rep"), sets, percent)
    labels = components(star.union(more).toDF("u", "v"))

    labels = stored(labels, "components")
    smallest = labels.join(classes.select(F.col("rep").alias("node"), "doc_id"), "node").groupBy("label")
    tops = labels.join(smallest.agg(F.min("doc_id").alias("top")), "label")
    named = classes.join(tops, F.col("rep") == F.col("node"), "left").select(
        *identity,
        F.coalesce("label", "rep").alias("component"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("top"),
    )
    component_id = F.when(F.col("n_shingles") > 0, F.col("top")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "text_key", *identity)
        .join(named, identity, "left")
        .withColumn("component_id", component_id)
        .select(
            "doc_id",
            "text_key",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
            "component",
        )
    )


def drop_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, all columns; rows without words all stay.

    Of repeated rows one stays. Only rows that are repeated are shuffled with their texts.
    """
    found = stored(groups(documents, words, percent).drop("component_id"), "groups")
    keys = ["doc_id", "text_key"]
    # Of several kept texts of one component, with its doc_id or all without, the one with
    # the smallest key stays.
    several = found.where("kept AND n_shingles > 0").groupBy("component").agg(
        F.min("text_key").alias("first"), F.max("text_key").alias("last")
    )
    several = several.where("first <> last").select("component", "first")
    later = found.where("kept AND n_shingles > 0").join(several, "component").where("text_key <> first")
    removed = stored(found.where("NOT kept").select(*keys).union(later.select(*keys)).distinct(), "removed")
    repeated = stored(
        found.where("kept AND n_shingles > 0").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys),
        "repeated",
    )

    def matching(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        side = broadcast_up_to(side, BROADCAST_REPS)
        same = rows["doc_id"].eqNullSafe(side["doc_id"]) & (text_key(rows["text"]) == side["text_key"])
        return rows.join(side, same, how)

    staying = matching(documents, removed, "left_anti")
    if repeated.isEmpty():
        return staying
    several = matching(staying, repeated, "left_semi").withColumn("__text_key", text_key(F.col("text")))
    return matching(staying, repeated, "left_anti").union(
        several.dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")
    )


def report(documents: DataFrame) -> DataFrame:
    """The query's columns: shingles of three words, linked from 85 hundredths on."""
    return groups(documents, words=3, percent=85).drop("text_key", "component")
