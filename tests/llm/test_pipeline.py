from __future__ import annotations

import re

import corpus_pipeline
from ledgerloom.llm import quality, secret_scan
from ledgerloom.llm.shared import stored

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_against_brute_force(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]

    # Quality: what the classifier, applied text by text, does not reject.
    good = stored(stages["quality"](spark, documents, FOLDER), "stage")
    machine = quality.train(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    scores = {i: machine.scores(quality._vector(text.encode(), [])[None])[0] for i, text in texts.items()}
    before = rows_of(good)
    assert set(before) == {i for i, score in scores.items() if score >= quality.THRESHOLD}
    assert good.columns == documents.columns

    # Near duplicates: the smallest id of each group by full sets of five words.
    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(r.text) for i, r in before.items()}
    top = {i: i for i in sets}
    for _ in range(8):
        for i in sets:
            for j in sets:
                common = len(sets[i] & sets[j])
                if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
    distinct = stored(stages["near_duplicates"](spark, good, FOLDER), "stage")
    assert set(rows_of(distinct)) == {i for i in sets if top[i] == i}
    assert distinct.columns == documents.columns

    # Contamination: a twentieth of the words in windows of 13.
    lowered = lambda text: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = lowered(r.text)
        n = min(13, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def contaminated(text):
        words, hit = lowered(text), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(words)

    clean = stored(stages["decontamination"](spark, distinct, FOLDER), "stage")
    assert set(rows_of(clean)) == {i for i, r in rows_of(distinct).items() if not contaminated(r.text)}

    # Secrets: every span replaced, everything else as it was.
    redacted = stored(stages["secrets"](spark, clean, FOLDER), "stage")
    after = rows_of(redacted)
    assert redacted.columns == documents.columns and set(after) == set(rows_of(clean))
    for i, r in rows_of(clean).items():
        spans = []
        for order, rule in enumerate(secret_scan.RULES):
            for match in re.compile(rule.expression, rule.flags | re.ASCII).finditer(r.text):
                if match.end(rule.group) - match.start(rule.group) >= rule.least:
                    spans.append((match.start(), order, match.end()))
        expected = secret_scan.redacted(r.text, [(secret_scan.RULES[o].kind, s, e) for s, o, e in sorted(spans)])
        assert after[i].text == expected and after[i].n_chars == len(expected)
        assert (after[i].lang, after[i].source) == (r.lang, r.source)

    # Packing: every remaining document, whole.
    packed = stages["packing"](spark, redacted, FOLDER).collect()
    covered = {}
    for p in packed:
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    assert covered == {p.doc_id: p.doc_tokens for p in packed} and set(covered) == set(after)

    whole = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_every_stage_takes_edge_rows(spark, docs):
    rows = [(1, None), (2, ""), (None, "some words"), (4, "copy of a text " * 30), (4, "copy of a text " * 30), (5, "long " * 40000)]
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs(rows, clashing=True), docs([])):
            out = stage(spark, table, FOLDER)
            kept = out.collect()
            if name != "packing":
                assert out.columns == table.columns
                assert {r.doc_id for r in kept} <= {i for i, _ in rows}
