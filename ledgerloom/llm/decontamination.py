"""Benchmark decontamination: word windows of the test items, found in the documents.

The method: the first two words of every benchmark window form a broadcast hash set, or
a bitmap of bounded size if they are many; every place of every document is looked up in
it, the few places that match are looked up again by their whole window, and a hit counts
only if all its words are equal.
Everything is DataFrame code; no Python runs on the executors.

Defined cases: a null text has no words; a text or item without words takes part in
nothing; a null doc_id is an id like any other, an item without an item_id is searched
but can be neither counted nor listed; repeated rows give one result each; equal windows
of several items name all of them; empty tables give no rows or clean documents. Columns
other than doc_id, text and item_id are ignored by ``scan`` and kept by the other two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ascii_lower, broadcast_up_to, stored, text_key

WINDOW = 13
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Up to this many (window, item) pairs the windows are broadcast: a pair is 13 words,
# a key and an id, some 300 bytes, so the bound is about 60 MB. Beyond it a bitmap of the
# leads is broadcast, and only places that hit it are shuffled, with their own words.
BROADCAST_WINDOWS = 200_000

# Words of 64 bits in that bitmap: at most this many rows of two longs, whatever the
# windows are. Bits that several leads share let more places through, never fewer.
BITMAP_WORDS = 1 << 21

# Findings of so many documents, some 100 bytes each, are broadcast to the documents.
BROADCAST_FINDINGS = 500_000


def words_of(text: Column, gap: str = GAP) -> Column:
    """The words of a whole text in order; none for null."""
    lowered = ascii_lower(text) if gap == GAP else text
    return F.coalesce(
        F.filter(F.split(lowered, gap), lambda word: word != ""), F.array().cast("array<string>")
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(lead, key, length, window, items): every distinct window with the items it is in.

    An item of fewer words than a window is one window of its own length.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    return (
        items.select("item_id", "words", length.alias("length"))
        .select(
            "item_id", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at")
        )
        .groupBy("length", F.slice("words", F.col("at"), F.col("length")).alias("window"))
        .agg(F.collect_set("item_id").alias("items"))
        .select(_lead(F.col("window")).alias("lead"), F.xxhash64("window").alias("key"), "length", "window", "items")
    )


def _lead(window: Column) -> Column:
    """Hash of the first two words, or of the only one."""
    return F.xxhash64(F.xxhash64(F.get(window, F.lit(0))), F.when(F.size(window) > 1, F.xxhash64(F.get(window, F.lit(1)))))


def _lead_bitmap(windows: DataFrame, bitmap_words: int) -> DataFrame:
    """(word, bits): the leads as set bits, at most ``bitmap_words`` rows."""
    bit = F.pmod(F.col("lead"), F.lit(bitmap_words * 64))
    mask = F.expr(f"shiftleft(1L, cast(pmod(lead, {bitmap_words * 64}L) % 64 as int))")
    return windows.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(mask).alias("bits"))


def _looked_up_by_bitmap(
    scanned: DataFrame, windows: DataFrame, keys: list[str], lengths: list[int], bitmap_words: int
) -> DataFrame:
    """The places whose lead is in the broadcast bitmap, each with its own window of every length
    that fits, joined with the windows by a shuffle.

    No row carries its whole text: a place takes along at most a window of words. The row
    of a document has a key of its own, so these rows do not meet in one partition.
    """
    n_words, bits = F.col("n_words"), 64 * bitmap_words
    hit = F.getbit("bits", (F.pmod(F.col("lead"), F.lit(bits)) % 64).cast("int")) == 1
    at = F.when(F.col("slot") > n_words, F.col("slot") - n_words).otherwise(F.col("slot"))
    longer = F.array(*[F.lit(length) for length in lengths if length > 1]).cast("array<int>")
    fitting = F.when(F.col("slot") == 0, F.array(F.lit(0))).when(F.col("slot") > n_words, F.array(F.lit(1)))
    candidates = (
        scanned.withColumn("word", F.floor(F.pmod(F.col("lead"), F.lit(bits)) / 64))
        .join(F.broadcast(_lead_bitmap(windows, bitmap_words)), "word", "left")
        .where((F.col("slot") == 0) | hit)
        .withColumn("at", at)
        .withColumn(
            "length",
            F.explode(fitting.otherwise(F.filter(longer, lambda length: F.col("at") + length - 1 <= n_words))),
        )
        .withColumn("found", F.when(F.col("slot") > 0, F.slice("words", F.col("at"), F.col("length"))))
        .withColumn("key", F.when(F.col("slot") > 0, F.xxhash64("found")).otherwise(F.xxhash64(*keys)))
        .select(*keys, "n_words", "slot", "at", "length", "found", "key")
    )
    return candidates.join(windows.drop("lead"), ["key", "length"], "left")


def places(
    documents: DataFrame, windows: DataFrame, keys: list[str], broadcast_windows: int, bitmap_words: int = BITMAP_WORDS
) -> DataFrame:
    """(keys, n_words, at, end, items): a row at 0 for each document row, and one for each
    place (words from 1, end exclusive) in it where a benchmark window occurs.

    ``documents`` has the keys and ``words``.
    """
    # One small job: how many windows there are and which lengths (13 values at most).
    counted = windows.groupBy("length").agg(F.sum(F.greatest(F.size("items"), F.lit(1))).alias("n")).collect()
    few = sum(row["n"] for row in counted) <= broadcast_windows

    hashed = documents.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word)))
    leads = F.transform("hashes", lambda value, i: F.xxhash64(value, F.get("hashes", i + 1)))
    if any(row["length"] == 1 for row in counted):
        # A window of one word is looked up at every place too; its rows follow the others.
        leads = F.concat(leads, F.transform("hashes", lambda value: F.xxhash64(value)))
    sentinel = F.array(F.lit(0).cast("long"))
    # The outer form: explode() would add a filter that splits every text once more.
    scanned = hashed.select(
        *keys, "words", F.size("words").alias("n_words"), F.posexplode_outer(F.concat(sentinel, leads)).alias("slot", "lead")
    )
    if few:
        joined = _looked_up_by_broadcast(scanned, windows)
    else:
        lengths = sorted(row["length"] for row in counted)
        joined = _looked_up_by_bitmap(scanned, stored(windows, "windows"), keys, lengths, bitmap_words)
    return joined.where((F.col("slot") == 0) | (F.col("found") == F.col("window"))).select(
        *keys,
        "n_words",
        F.when(F.col("slot") > 0, F.col("at")).otherwise(0).alias("at"),
        F.when(F.col("slot") > 0, F.col("at") + F.col("length")).otherwise(0).alias("end"),
        "items",
    )


def _looked_up_by_broadcast(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """The places whose lead is in the broadcast hash set, joined with the broadcast windows."""
    n_words = F.col("n_words")
    looked_up = (
        scanned.join(F.broadcast(windows.select("lead", "length").distinct()), "lead", "left")
        .where((F.col("slot") == 0) | F.col("length").isNotNull())
        .withColumn("at", F.when(F.col("slot") > n_words, F.col("slot") - n_words).otherwise(F.col("slot")))
        # The last place has no second word, so its lead is that of a single word.
        .where((F.col("slot") <= n_words) | (F.col("length") == 1))
        .withColumn("found", F.when(F.col("slot") > 0, F.slice("words", F.col("at"), F.col("length"))))
        .withColumn("key", F.xxhash64("found"))
        .drop("lead")
    )
    return looked_up.join(F.broadcast(windows.drop("lead")), ["key", "length"], "left")


def merged(spans: Column) -> Column:
    """Sorted (at, end) places joined into disjoint runs."""
    empty = F.array().cast("array<struct<at:int,end:int>>")

    def step(runs, span):
        last = F.element_at(runs, -1)
        longer = F.struct(last["at"].alias("at"), F.greatest(last["end"], span["end"]).alias("end"))
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))
        return F.when((F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["end"] >= span["at"]), joined).otherwise(
            F.concat(runs, F.array(span))
        )

    return F.aggregate(spans, empty, step)


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
    bitmap_words: int = BITMAP_WORDS,
) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, hit_runs, item_ids, contaminated) per document row.

    ``hit_runs`` are the disjoint runs of hit words (from 1, end exclusive), ``item_ids``
    the items with a window in the document as sorted strings. A document is contaminated
    if a twentieth of its words or more are hit. Only places that hit and one row per
    document are shuffled.
    """
    keys = ["doc_id", "text_key"]
    words = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    found = places(words, item_windows(benchmark, window), keys, broadcast_windows, bitmap_words)
    hit = F.col("at") > 0
    grouped = found.groupBy(*keys).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(~hit).alias("copies"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("at", "end")))).alias("spans"),
        F.collect_set(F.when(hit, F.transform("items", lambda item: item.cast("string")))).alias("items"),
    )
    runs = grouped.withColumn("hit_runs", merged(F.col("spans")))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["at"])
    return (
        runs.withColumn("n_hit", n_hit)
        .withColumn("item_ids", F.array_sort(F.array_distinct(F.flatten("items"))))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(*keys, "n_words", "n_hit", "hit_runs", "item_ids", "contaminated")
    )


def _same(documents: DataFrame, findings: DataFrame) -> Column:
    """Joins rows with their findings; columns are told by their frame, whatever their names."""
    return documents["doc_id"].eqNullSafe(findings["doc_id"]) & (text_key(documents["text"]) == findings["text_key"])


def _once(findings: DataFrame) -> DataFrame:
    """Each finding once, broadcast if they are few enough."""
    return broadcast_up_to(stored(findings.dropDuplicates(["doc_id", "text_key"]), "findings"), BROADCAST_FINDINGS)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, all columns, that are not contaminated."""
    bad = _once(scan(documents, benchmark, **options).where("contaminated").select("doc_id", "text_key"))
    return documents.join(bad, _same(documents, bad), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with the hit words cut out of their texts, each with what follows it
    up to the next word. Other columns stay; ``text`` of clean rows is unchanged."""
    findings = scan(documents, benchmark, **options).where("n_hit > 0")
    side = _once(findings.select("doc_id", "text_key", F.struct("hit_runs", "n_words").alias("found")))
    text, found = documents["text"], side["found"]
    words, gaps = words_of(text, CASED_GAP), F.split(text, CASED_WORD, -1)
    # Piece 0 is what precedes the first word, piece k the k-th word and what follows it.
    pieces = F.concat(F.slice(gaps, 1, 1), F.transform(words, lambda word, i: F.concat(word, F.get(gaps, i + 1))))
    runs, n = found["hit_runs"], found["n_words"].cast("int")
    kept_from = F.concat(F.array(F.lit(0)), F.transform(runs, lambda run: run["end"]))
    kept_to = F.concat(F.transform(runs, lambda run: run["at"]), F.array(n + 1))
    kept = F.zip_with(kept_from, kept_to, lambda a, b: F.struct((a + 1).alias("at"), (b - a).alias("length")))
    joined = documents.join(side, _same(documents, side), "left").select(
        *[documents[name] for name in documents.columns if name != "text"],
        text.alias("text"),
        F.when(found.isNotNull(), F.struct(pieces.alias("pieces"), kept.alias("kept"))).alias("__cut"),
    )
    cut = F.transform("__cut.kept", lambda run: F.slice(F.col("__cut.pieces"), run["at"], run["length"]))
    clean = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(cut), ""))
    return joined.withColumn("text", clean).select(*documents.columns)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    return scan(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )
