import base64
import hashlib
import io
import re
import struct
from html.parser import HTMLParser

import pyarrow as pa
import pytest
import zstandard

from barloom.llm import warc
from barloom.llm.html_extract import extract_main_text, main_text

LONG = "A paragraph of the article that is long enough to be one, with words and more words after them."
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/a'>A</a></ul></nav>"
    "<!-- ad <p>no</p> --><div class='ad'>Buy this.</div><div id='cookie-notice'>We use cookies.</div><aside>Side</aside><article><h1>Title &amp; more</h1><p><b>First&nbsp; line<br>goes on<p>Short.</p>"
    "<form><input value='x'>Search</form><div class=\"share-buttons\">Tweet</div><p>Last  \n one &eacute; &#8364;</p></article><section class='comments'><p>Nice <div>deep</div> post</p></section><footer>&copy; me</footer></body></html>"
)
PLAIN = f"<div id=menu><a href=x>Home</a> <a>About</a></div><div><a href=1>Link one of many</a></div><div>{LONG}</div><p>Second.</p><p>Third one.</p><div class='footer'>bye</div>"


@pytest.mark.parametrize(("page", "want"), [
    (PAGE, "Title & more\n\nFirst line goes on\n\nShort.\n\nLast one é €"), (PLAIN, f"{LONG}\n\nSecond.\n\nThird one."), (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"),
    ("<article><p>cut off", "cut off"), ("<article>a<p>b</article><footer>c", "a\n\nb"), ("<p>a < b and 3<4</p>", "a < b and 3<4"), ("<main><p>x</p><nav>menu</nav><p>y</p></main>", "x\n\ny"),
    ("<article><p>" + "x" * 300_000 + "</p></article>", "x" * 300_000), ("<nav><p>never closed<article><p>kept</p></article>", ""), ("<script>only()</script>", ""),
    ("<article><p class=ad>buy<p>real<ul><li class='promo'>x<li>y</ul><p class=ad>z</p>w</article>", "real\n\ny\n\nw"),
    ('<article><p title="the hidden treasure">Keep me</p><p>B</p></article>', "Keep me\n\nB"), ('<article><h2 id="related-work">Related work</h2><p>x</p></article>', "Related work\n\nx"),
    ('<div class="side-by-side">Body text</div>', "Body text"), ("one <a title=don't href=x>link</a> two", "one link two"), ("<article><p hidden>no</p><p aria-hidden='true'>no</p><p style='display: none'>no</p>yes</article>", "yes"),
    ("<head><title>T</title><article><p>no end of the head</article>", "no end of the head"), ("<article>a <svg><title>t</title><text>no</text></svg> b <select>c</article>", "a b c"),
    ("<article><div class='no-sidebar'>x</div><div class='site-footer'>y</div></article>", "x"), ("<article>a<p title=\"never closed>b</p></article>", "a\n\nb"),
    ("<div>Buy this now, it is cheap and good.</div><h1>Title</h1><p>" + LONG + "</p><p>End.</p>", f"Title\n\n{LONG}\n\nEnd."), ("<p>" + "<a title='" * 20_000, ""),
])
def test_main_text(page, want):
    assert main_text(page) == want


class Reference(HTMLParser):
    """An extractor of its own for pages as those of the tables: blocks in article, none of its asides."""

    def __init__(self):
        super().__init__()
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("nav", "footer", "script", "style")
        self.blocks.append("") if tag in ("article", "h1", "p", "div", "li", "ul") else self.handle_data(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("nav", "footer", "script", "style")
        if tag in ("article", "h1", "p", "div", "li", "ul"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data

    @classmethod
    def text(cls, page):
        parser = cls()
        parser.feed(page)
        parser.close()
        return "\n\n".join(t for b in parser.blocks if (t := " ".join(b.split())))


def test_pages_of_the_table_by_marks_and_by_lines_alone(spark):
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert len(pages) > 100
    for page in pages:
        want = Reference.text(page)
        assert main_text(page) == want
        bare = re.sub(r"</?(?:article|main)\b[^>]*>|\sclass=(?:\"[^\"]*\"|'[^']*')", "", page)
        assert "<article" not in bare and "class=" not in bare and main_text(bare) == want


def test_extract_keeps_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "k", "old"), (2, None, None, None, None), (2, None, None, None, None)], "page_id long, url string, html string, extra string, text string")
    got = extract_main_text(rows).orderBy("page_id").collect()
    assert got[0].asDict() == {"page_id": 1, "url": "u", "extra": "k", "text": main_text(PAGE), "n_chars": len(main_text(PAGE))}
    assert [r["text"] for r in got[1:]] == ["", ""] and extract_main_text(rows.limit(0)).collect() == []


PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (7, "http://c", "same"), (3, "http://d", None), (4, None, ""), (5, "http://e\nx", "é" * 400_000), (6, "http://f", "alone\r\n\r\nWARC/1.1\r\n"), (None, "http://g", "same"), (8, "u", "twice"), (8, "u", "twice")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_warc(pages)
    rows = warc.read_warc(index).collect()
    assert len(rows) == len(PAGES)
    want = []
    for i, _, t in PAGES:
        top = max(p[0] for p in PAGES if (p[2] or "") == (t or "") and p[0] is not None)
        revisit = i != top
        want.append((i, len((t or "").encode()), digest(t), "revisit" if revisit else "response", top if revisit else None, None if revisit else (t or "").encode()))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in index.collect():
        assert warc.lookup(r["bundle"], r["frame"], r["offset"])[0] == r["page_id"]


def test_small_payloads_may_be_exempt(spark):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.read_warc(warc.write_warc(pages, min_bytes=5)).collect()} == {"response"}
    assert warc.read_warc(warc.write_warc(pages.limit(0))).collect() == []


def test_bundles_are_seekable_zstandard():
    stream = io.BytesIO()
    stream.close = lambda: None
    bundle = warc.Bundle(stream)
    records = [warc.make_record(i, "http://x", bytes([65 + i % 26]) * 40_000, None, False) for i in range(20)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    data = stream.getvalue()
    assert struct.unpack("<IBI", data[-9:]) == (bundle.sizes.__len__(), 0, warc.SEEKABLE) and len(bundle.sizes) > 2
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(records)  # any reader skips the footer
    file = pa.BufferReader(data)
    table = warc.seek_table(file, len(data))
    for (frame, offset, length), record in zip(places, records, strict=True):
        assert warc.read_frame(file, table, frame)[offset : offset + length] == record
    broken = records[0].replace(b"AAAA", b"AAAB", 1)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(broken)
