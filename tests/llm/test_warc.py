from __future__ import annotations

import base64
import glob
import gzip
import hashlib
from html.parser import HTMLParser

import pytest

from ledgerloom.llm import warc as op


class Reader(HTMLParser):
    """Visible words and links, as the standard library's parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.links, self.hidden = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "template", "noscript")
        self.links += bool(tag in op._LINKS and (dict(attrs).get(op._LINKS[tag]) or "").strip())

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "template", "noscript")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def parse(data: bytes):
    """(headers, block) of each record of a file."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        yield headers, rest[:size]
        data = rest[size + 4 :]


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    records = op.report(pages).collect()
    sources = {r.page_id: r for r in op.responses(pages, "2024-01-01T00:00:00Z").collect()}
    assert len(records) == 2 * len(sources)
    assert len({r.record_id for r in records}) == len(records)
    for r in records:
        source = sources[r.page_id]
        reader = Reader()
        reader.feed(source.body)
        assert r.refers_to == source.record_id and r.target_uri == source.target_uri
        assert r.source_payload_digest == digest(source.body.encode())
        assert r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.n_links == reader.links
        if r.record_type == "conversion":
            assert "".join(r.block.split()) == "".join(reader.words)
        else:
            assert f"source-payload-digest: {r.source_payload_digest}\r\n" in r.block
            assert "http-header: Content-Type: text/html; charset=UTF-8\r\n" in r.block
            assert r.block.count("\r\noutlink: ") == r.n_links


def test_files_can_be_read_back(spark, tmp_path):
    rows = [(1, "http://a.example/x/", "<p>One<br>two &amp; <b>th</b>ree\r\n\r\n<a href='../y?z'>y</a>"), (2, None, None)]
    records = op.report(spark.createDataFrame(rows, "page_id long, url string, html string"))
    op.write(records, str(tmp_path / "out"))
    data = [gzip.open(path).read() for path in sorted(glob.glob(f"{tmp_path}/out/part-*.gz"))]
    found = {headers["WARC-Record-ID"]: (headers, block) for part in data for headers, block in parse(part)}
    for r in records.collect():
        headers, block = found.pop(r.record_id)
        assert headers["WARC-Type"] == r.record_type and headers["WARC-Refers-To"] == r.refers_to
        assert headers["WARC-Block-Digest"] == digest(block) and block == r.block.encode()
        assert headers.get("WARC-Target-URI") == r.target_uri
    assert not found


@pytest.mark.parametrize(
    "body,text,links",
    [
        ("", "", []),
        ("plain & simple", "plain & simple", []),
        ("<script>var a = '<p>no</p>'</script>yes<!-- no", "yes", []),
        ("<title>T &lt; U</title><h1>A</h1>B<td>c<td>d", "A\nB c d", []),
        ("<a href=rel>x</a><img src='/i.png'><a name=q>", "x", ["http://h/d/rel", "http://h/i.png"]),
        ("<base href='http://b/c/'><a href='d'>", "", ["http://b/c/d"]),
        ("a < b <c", "a < b <c", []),
        ("<p title=\"a > b\">in</p>", "in", []),
    ],
)
def test_pages(body, text, links):
    page = op.read_page(body, "http://h/d/e")
    assert page.text == text
    assert [url for url, _ in page.links] == links


@pytest.mark.parametrize(
    "body,text,links",
    [
        ('<a href="/y" onclick="if(a<b)go()">z</a>', "z", ["http://h/y"]),
        ("<a data-x='<b>x</b>' href='/y'>z</a>", "z", ["http://h/y"]),
        ('<img alt="x < y" src=/i><p title="a<b">in</p>', "in", ["http://h/i", ]),
        ('<script src="/s" data-x="<b>">var a = "<p>"</script>on', "on", ["http://h/s"]),
        ('<script data-x="a>b" src="/s">no</script>on<SCRIPT a="<">no', "on", ["http://h/s"]),
        ("<title it's>T</title>on", "on", []),
        ('a <b "c <i>d</i> "e', 'a <b "c d "e', []),
        ('<a href="/y>z</a> and <p>more', '<a href="/y>z and\nmore', []),
        ("1 <a 2 <a href='<' >x</a>", "1 <a 2 x", ["http://h/d/<"]),
    ],
)
def test_quoted_values_may_hold_tags(body, text, links):
    page = op.read_page(body, "http://h/d/e")
    assert page.text == text
    assert [url for url, _ in page.links] == links


def test_pages_are_read_in_linear_time():
    import time

    for part in ("<a \"", "<a x='\"' y=\" ", "<a b='", "<a b=\"<a b='", "<p a=\"<\" ", "<script a='"):
        took = []
        for n in (5_000, 40_000):
            start = time.perf_counter()
            op.read_page(part * n, None)
            took.append(time.perf_counter() - start)
        assert took[1] < 30 * took[0] + 0.5


def test_edges(spark):
    schema = "page_id long, url string, html string, headers string, block string"
    rows = [(None, None, None, "x", "y"), (1, "http://a/", "<p>" * 20000, "x", "y"), (1, "http://a/", "<p>" * 20000, "x", "y")]
    found = op.report(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 6 and all(r.block == "" for r in found if r.record_type == "conversion")
    assert op.report(spark.createDataFrame([], schema)).count() == 0
