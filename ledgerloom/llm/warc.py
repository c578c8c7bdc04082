"""WARC derivatives: metadata and plain-text conversion records of archived responses.

Every response becomes two records that refer to it. The metadata record lists the source's
digests, its HTTP status and headers, title, language, charset and outgoing links; the
conversion record is the visible text. Both carry the source's record id, target URI and
date, and a digest of their own block. Record ids are derived from the source's, so
a task that runs again writes the same records. One pass, no shuffle.

Defined cases: a null body is an empty one and gives both records, the text empty; a null
target URI leaves that header out and links relative; null source headers give none;
repeated rows give repeated records; unclosed tags, comments and scripts run to the end of
the page; an empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WARC_VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs

_SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, source_block_digest string, "
    "source_payload_digest string, n_links long, headers string, block string"
)

# One token of markup; what is unclosed reaches to the end of the page. Here no tag reaches
# over the next "<", so that no page makes the search start over and over; ``odd`` is the
# start of what may be a tag with "<" in quoted values, which _TagEnds tells.
_QUOTED = r"(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|template|noscript|title)\b(?P<rawattrs>{_QUOTED})>(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>{_QUOTED})>"
    r"|<[!?][^<>]*>"
    r"|<(?P<odd>/?[a-z][a-z0-9:-]*)",
    re.IGNORECASE | re.DOTALL,
)
_RAW = re.compile(r"(script|style|template|noscript|title)\b", re.IGNORECASE)
_RAW_END = {
    name: re.compile(rf"(.*?)(?:</{name}\s*>|\Z)", re.IGNORECASE | re.DOTALL)
    for name in ("script", "style", "template", "noscript", "title")
}
_UNQUOTED = re.compile(r"[^<>\"']*")
_NO_MARKS = re.compile(r"[^<>]*>")
_ATTRIBUTE = re.compile(r"([a-z][a-z0-9:_-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}
_BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table "
    "tbody tfoot thead tr ul".split()
)


@dataclass
class Page:
    """What a page shows and tells about itself."""

    text: str = ""
    title: str = ""
    language: str = ""
    charset: str = ""
    links: list[tuple[str, str]] = field(default_factory=list)


def _attributes(text: str | None) -> dict[str, str]:
    if not text:
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _tidy(text: str) -> str:
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


class _TagEnds:
    """Where tags of one page end whose quoted values may hold "<", in time linear in the page.

    Only a value, after "=", may hold one. Places outside quotes from which no end was
    found, and quotes that nothing closes, are remembered, so nothing is read twice.
    """

    def __init__(self, body: str):
        self.body, self.dead = body, set()
        self.unclosed = {'"': len(body), "'": len(body)}

    def after(self, at: int) -> int | None:
        """The place of the ">" of a tag whose attributes start there; None if it has none."""
        body, visited = self.body, []
        while at not in self.dead:
            visited.append(at)
            mark = _UNQUOTED.match(body, at).end()
            quote = body[mark : mark + 1]
            if quote == ">":
                return mark
            if quote not in self.unclosed or mark >= self.unclosed[quote]:
                break
            end = body.find(quote, mark + 1)
            if end < 0:
                self.unclosed[quote] = mark
                break
            if body.find("<", mark, end) >= 0 and not body[at:mark].rstrip().endswith("="):
                break
            at = end + 1
        self.dead.update(visited)
        return None


def _tokens(body: str) -> Iterator[tuple[int, int, str, str | None, str | None]]:
    """(start, end, tag, attributes, inner) of the markup; ``inner`` is the text of raw elements.

    Comments and the like have no tag, closing tags no attributes.
    """
    at, ends = 0, None
    while True:
        for match in _MARKUP.finditer(body, at):
            odd = match["odd"]
            if odd is None:
                raw = match["raw"]
                tag = (raw or match["tag"] or "").lower()
                yield match.start(), match.end(), tag, match["rawattrs"] if raw else not match["close"] and match["attrs"] or None, match["inner"]
                continue
            ends = ends or _TagEnds(body)
            start = match.end()
            name = _RAW.match(odd)
            end = ends.after(start)
            if end is None and name:  # stray quotes do not keep a raw element from being one
                plain = _NO_MARKS.match(body, start)
                end = plain.end() - 1 if plain else None
            if end is None:
                continue
            if name:
                tag = name[1].lower()
                inner = _RAW_END[tag].match(body, end + 1)
                yield match.start(), inner.end(), tag, body[match.start() + 1 + len(tag) : end], inner[1]
                at = inner.end()
            else:
                yield match.start(), end + 1, odd.lstrip("/").lower(), None if odd[0] == "/" else body[start:end], None
                at = end + 1
            break
        else:
            return


def read_page(body: str, base: str | None) -> Page:
    """Visible text, title, language, charset and absolute links of an HTML page."""
    page, shown, at = Page(), [], 0
    base = base or ""
    for start, end, tag, attrs, inner in _tokens(body):
        shown.append(body[at:start])
        at = end
        if not tag:
            continue
        if inner is not None:
            if tag == "title" and not page.title:
                page.title = _tidy(html.unescape(inner)).replace("\n", " ")
            attributes = _attributes(attrs) if tag == "script" else {}
        else:
            attributes = _attributes(attrs)
        if tag in _BREAKS:
            shown.append("\n")
        elif tag in ("td", "th"):
            shown.append(" ")
        if tag in _LINKS and attributes.get(_LINKS[tag], "").strip():
            try:
                page.links.append((urljoin(base, attributes[_LINKS[tag]].strip()), f"{tag}/@{_LINKS[tag]}"))
            except ValueError:  # no URL at all: kept as it is written
                page.links.append((attributes[_LINKS[tag]].strip(), f"{tag}/@{_LINKS[tag]}"))
        elif tag == "base" and attributes.get("href"):
            base = urljoin(base, attributes["href"])
        elif tag == "html":
            page.language = page.language or attributes.get("lang", "")
        elif tag == "meta":
            page.charset = page.charset or attributes.get("charset", "")
    shown.append(body[at:])
    page.text = _tidy(html.unescape("".join(shown)))
    return page


def digest(data: bytes) -> str:
    """A labelled SHA-1 in base 32, as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record_id} {kind}')}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _fields(pairs: list[tuple[str, str | None]]) -> str:
    return "".join(f"{name}: {_one_line(value)}\r\n" for name, value in pairs if value)


def derivatives(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    body, http = source["body"] or "", source["http_headers"] or ""
    payload = body.encode("utf-8", "replace")
    page = read_page(body, source["target_uri"])
    block_digest, payload_digest = digest(http.encode("utf-8", "replace") + payload), digest(payload)
    lines = http.split("\r\n")
    facts = [
        ("source-block-digest", block_digest),
        ("source-payload-digest", payload_digest),
        ("http-status", lines[0]),
        *(("http-header", line) for line in lines[1:]),
        ("title", page.title),
        ("language", page.language),
        ("charset", page.charset),
        *(("outlink", f"{url} {place}") for url, place in page.links),
    ]
    records = []
    for kind, content_type, block in (
        ("metadata", "application/warc-fields", _fields(facts)),
        ("conversion", "text/plain; charset=UTF-8", page.text),
    ):
        data = block.encode("utf-8", "replace")
        record = {
            "page_id": source["page_id"],
            "record_type": kind,
            "record_id": derived_id(source["record_id"], kind),
            "refers_to": source["record_id"],
            "target_uri": source["target_uri"],
            "date": source["date"],
            "content_type": content_type,
            "content_length": len(data),
            "block_digest": digest(data),
            "source_block_digest": block_digest,
            "source_payload_digest": payload_digest,
            "n_links": len(page.links),
            "block": data.decode("utf-8"),
        }
        record["headers"] = f"{WARC_VERSION}\r\n" + _fields(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", record["record_id"]),
                ("WARC-Date", record["date"]),
                ("WARC-Target-URI", record["target_uri"]),
                ("WARC-Refers-To", record["refers_to"]),
                ("WARC-Refers-To-Target-URI", record["target_uri"]),
                ("WARC-Refers-To-Date", record["date"]),
                ("WARC-Block-Digest", record["block_digest"]),
                ("Content-Type", content_type),
                ("Content-Length", str(len(data))),
            ]
        )
        records.append(record)
    return records


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Pages (page_id, url, html) as responses fetched at that date (UTC, ISO 8601).

    The record id is a name-based UUID of page id and URL.
    """
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    spread = F.regexp_replace(key, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5")
    return pages.select(
        F.col("page_id").cast("long"),
        F.concat(F.lit("<urn:uuid:"), spread, F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
            F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"),
            F.lit("\r\n\r\n"),
        ).alias("http_headers"),
        F.col("html").alias("body"),
    )


def derive(sources: DataFrame) -> DataFrame:
    """Two records per response (page_id, record_id, target_uri, date, http_headers, body)."""
    names = ["page_id", "record_id", "target_uri", "date", "http_headers", "body"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200).to_pylist()
                yield pa.RecordBatch.from_pylist([r for source in part for r in derivatives(source)], schema=schema)

    schema = pa.schema(
        [
            (name, pa.int64() if kind == "long" else pa.string())
            for name, kind in (column.split() for column in _SCHEMA.split(", "))
        ]
    )
    return sources.select(*names).mapInArrow(build, _SCHEMA)


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the records as WARC files, one per partition; each record ends with two line ends."""
    record = F.concat("headers", F.lit("\r\n"), "block")
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def report(pages: DataFrame) -> DataFrame:
    """The records of all pages, as of one fixed crawl date."""
    return derive(responses(pages, "2024-01-01T00:00:00Z"))
