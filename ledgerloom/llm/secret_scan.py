"""Secret scans: regular expressions, run only where a trigram index finds candidates.

Every rule's expression implies a Boolean query of trigrams that a matching text must
contain (``trigrams.query_of``). A task indexes the texts block by block, intersects and
unites postings for each rule, and runs the expression over the whole of each candidate.
Rules that imply no trigram, such as long hexadecimal runs, scan every text. An index
shard lives with its block of documents, so nothing is shuffled and any lost task can be
run again alone.

Defined cases: null and empty texts have no spans; repeated rows and null doc_ids give one
result each; spans of different rules may overlap and are all listed; ``redact`` joins
overlapping ones. Positions are code points. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.trigrams import Index, query_of, trigrams_of

BLOCK_BYTES = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if the group has at least ``least`` characters."""

    kind: str
    expression: str
    group: int = 0
    least: int = 1
    flags: int = 0

    def pattern(self) -> re.Pattern:
        # ASCII: ignoring case must not let other letters fold into these.
        return re.compile(self.expression, self.flags | re.ASCII)


# The first three kinds and their order are the query's base rules.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        flags=re.IGNORECASE,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
# A key reaches to its END line; without one, over the base64 that follows, after header
# fields, however it is wrapped, quoted or escaped. No key reaches over the next BEGIN.
_KEY_NAME = r"[A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
_KEY_GAP = r"""(?:[\s>#*|"',+]|\\[nr])*+"""
_KEY = (
    rf"-----BEGIN {_KEY_NAME}"
    rf"(?:[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END {_KEY_NAME}"
    rf"|(?:{_KEY_GAP}(?:(?:Proc-Type|DEK-Info):[ \t]*\S+|[A-Za-z][A-Za-z0-9-]*:[^\n]*+(?=\n)))*+"
    rf"(?:{_KEY_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_KEY_GAP}[A-Za-z0-9+/]{{1,15}}+(?:=+|(?=[ \t\r]*(?:\n|\Z))))?)?"
)
# Public formats of well-known tokens.
FORMATS = (
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", _KEY),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]{16,}", flags=re.IGNORECASE),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]++:[^\s:/@]++@"),
)
RULES = BASE + FORMATS

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


class Scanner:
    """Finds the spans of all rules in blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(rule, self._compiled(rule)) for rule in rules]
        self.queries = [query_of(rule.pattern()) for rule in rules]
        self.index = Index(sorted(set().union(*map(trigrams_of, self.queries))))

    @staticmethod
    def _compiled(rule: Rule) -> re.Pattern:
        # A run of one class is found as a whole, so its length can be asked for at once.
        if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.expression):
            return re.compile(f"{rule.expression[:-1]}{{{rule.least},}}", rule.flags | re.ASCII)
        return rule.pattern()

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Per text, by start and then by the order of the rules."""
        self.index.build([text.encode("utf-8", "surrogatepass") for text in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for order, ((rule, pattern), query) in enumerate(zip(self.rules, self.queries)):
            for i in self.index.answer(query).tolist():
                for match in pattern.finditer(texts[i]):
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        found[i].append((match.start(), order, match.end()))
        return [[(self.rules[o][0].kind, start, end) for start, o, end in sorted(spans)] for spans in found]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(batch: pa.RecordBatch, scanner: Scanner) -> list[list[tuple[str, int, int]]]:
    texts = [text or "" for text in batch.column("text").to_pylist()]
    return [spans for block in _blocks(texts) for spans in scanner.spans(block)]


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) per row: every span of every rule, by start and the rules' order."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), span)) for span in spans] for spans in _found(batch, scanner)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of spans replaced by the kind of its first."""
    out, reached = [], 0
    for kind, start, end in spans:
        if start >= reached:
            out += [text[reached:start], f"<{kind}>"]
        reached = max(reached, end)
    return "".join([*out, text[reached:]])


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``documents``, secrets in ``text`` replaced by their kinds."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            clean = [
                redacted(text, spans) if spans else text for text, spans in zip(texts, _found(batch, scanner))
            ]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return documents.mapInArrow(apply, documents.schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(documents: DataFrame) -> DataFrame:
    """The query's columns."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([rule.kind for rule in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in BASE]
    return scan(documents).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
