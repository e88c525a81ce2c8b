"""WARC derivatives: visible text against an HTML parser, links between records, round trips."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

from pyspark.sql import functions as F

from touchline.llm import queries
from touchline.llm import warc_derive as W


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in W.HIDDEN
        if tag in W.LINES:
            self.text.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in W.HIDDEN
        if tag in W.LINES:
            self.text.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data.replace("\n", " "))


def parsed(markup):
    r = Reader()
    r.feed(markup)
    r.close()
    lines = (" ".join(x.split()) for x in "".join(r.text).split("\n"))
    return "\n".join(x for x in lines if x)


def test_text_against_a_parser(spark):
    for (html,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        assert W.visible_text(html) == parsed(html)
    for html in ("", "plain", "a<br>b", "<p>a&lt;b&gt; &amp;amp; &eacute;&#x41;&nbsp;c</p>", "<script>if (a<b) x('</p>')</script>ok", "a<!-- <p>no</p> -->b", "x < y and <b>bold</b>ly"):
        assert W.visible_text(html) == parsed(html), html


def test_hidden_elements_without_an_end_tag():
    for html, text in (("<html><head><title>t</title><body><p>All the text", "All the text"), ("<head><meta charset=x><style>p {}</style>\n<p>one<p>two", "one\ntwo"),
                       ("<head><title>t</title><script>'<body>'</script></head><p>one</p>", "one"), ("<head><!-- <p>no --><title>t<b></title><link rel=x>one", "one"),
                       ("<p>one</p><svg width=1 /><p>two</p>", "one\ntwo"), ("one<math/> two", "one two"), ("one<svg><text>no</text></svg> two", "one two"),
                       ("<svg><p>one</p>", "one"), ("one <object data=x>two", "one two"), ("one<template>two", "onetwo"),
                       ("<head-line>one</head-line><p>two", "one\ntwo"), ("<svg-icon>one</svg-icon> <p-x>two</p-x>", "one two"),
                       ("one<script>no", "one"), ("one<style>no<p>no", "one"), ("one<iframe src=x>no", "one"), ("one<!-- no", "one")):
        assert W.visible_text(html) == text, html


def derive(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, rid string, url string, head string, html string, block string, header string")
    return W.derive(df, keep="page_id", record_id=F.col("rid"), target=F.col("url"), date=F.lit("2024-01-01T00:00:00Z"), http_head=F.col("head"), payload=F.col("html"))


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_are_linked(spark):
    html = "<html lang='fr'><head><title>A &amp;\n b</title></head><body><a href='/x?a=1&amp;b'>l</a><a href=\"http://o.test/\">m</a><a href=/x?a=1&b>again</a>Été</body></html>"
    meta, text = sorted(derive(spark, [(1, "<urn:x>", "http://h.test/p", "HTTP/1.1 200 OK\r\nServer: s\r\nX-A: b", html, None, None)]).collect(), key=lambda r: r["record_type"], reverse=True)
    assert (meta["record_type"], text["record_type"]) == ("metadata", "conversion")
    assert meta["refers_to"] == text["refers_to"] == "<urn:x>" and meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    assert meta["source_digest"] == text["source_digest"] == sha(html.encode()) and text["block_digest"] == sha(text["block"].encode())
    assert meta["block"].split("\r\n")[2:-1] == ["source-header: HTTP/1.1 200 OK", "source-header: Server: s", "source-header: X-A: b", "title: A & b", "language: fr",
                                                 "outlink: http://h.test/x?a=1&b", "outlink: http://o.test/"]
    assert text["block"] == "lm againÉté".replace(" ", "") and text["block_length"] == len(text["block"].encode())


def test_round_trip(spark):
    records = W.serialised(derive(spark, [(i, f"<urn:{i}>", f"http://h.test/{i}", None, f"<p>é{i}</p>\r\n\r\nWARC/1.1" * i, None, None) for i in range(5)])).collect()
    for data in (b"".join(bytes(r["warc"]) for r in records), b"".join(gzip.compress(bytes(r["warc"])) for r in records)):
        back = list(W.parse(data))
        assert [(h["warc-type"], h["warc-record-id"], h["warc-refers-to"], h["warc-block-digest"], b.decode()) for h, b in back] == [
            (r["record_type"], r["record_id"], r["refers_to"], sha(b"" + r["block"].encode()), r["block"]) for r in records]


def test_reads_responses(spark, scratch):
    body = "<p>Ünï</p>".encode()
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: http://a.test/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    other = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    with open(f"{scratch}/a.warc.gz", "wb") as f:
        f.write(gzip.compress(other) + gzip.compress(one))
    got = W.responses(spark.read.format("binaryFile").load(scratch)).collect()
    assert [tuple(r) for r in got] == [("<urn:1>", "http://a.test/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nA: b", "<p>Ünï</p>")]


def test_responses_keep_their_digest_and_charset(spark, scratch):
    """Codings undone, text by the declared charset, the source's digest and WARC headers passed on."""
    chunked = lambda b: b"3\r\n" + b[:3] + b"\r\n" + b"%x;x=y\r\n" % len(b[3:]) + b[3:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    jis, latin, utf = "<p>日本語</p>".encode("shift_jis"), "<p>Été</p>".encode("latin-1"), "<p>Été</p>".encode()
    deflated = raw.compress(utf) + raw.flush()
    cases = [(b"Content-Type: text/html; charset=ISO-8859-1", latin, latin, "<p>Été</p>"), (b"Content-Type: text/html; charset=Shift_JIS", jis, jis, "<p>日本語</p>"),
             (b"X: y", b"<meta charset=shift_jis>" + jis, b"<meta charset=shift_jis>" + jis, "<meta charset=shift_jis><p>日本語</p>"),
             (b"Transfer-Encoding: chunked", chunked(utf), utf, "<p>Été</p>"), (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(utf, mtime=0)), gzip.compress(utf, mtime=0), "<p>Été</p>"),
             (b"Content-Encoding: deflate", zlib.compress(utf), zlib.compress(utf), "<p>Été</p>"), (b"Content-Encoding: deflate", deflated, deflated, "<p>Été</p>"),
             (b"Content-Encoding: unheard-of", utf, utf, None)]
    with open(f"{scratch}/a.warc", "wb") as f:
        for given in (b"WARC-Payload-Digest: sha1:GIVEN\r\nWARC-IP-Address: 192.0.2.1\r\n", b""):
            for i, (head, body, _, _) in enumerate(cases):
                block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
                f.write(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\n%sContent-Length: %d\r\n\r\n" % (i, given, len(block)) + block + b"\r\n\r\n")
    read = W.source_responses(spark.read.format("binaryFile").load(scratch))
    got = read.collect()
    assert [r["payload"] for r in got] == [text for *_, text in cases] * 2
    assert [r["payload_digest"] for r in got] == ["sha1:GIVEN"] * len(cases) + [sha(body) for _, _, body, _ in cases]
    made = W.derive(read.withColumnRenamed("record_id", "rid"), keep="rid", record_id=F.col("rid"), **{c: F.col(c) for c in ("target", "date", "http_head", "payload", "payload_digest", "payload_length", "warc_head")})
    records = [r for x in got for r in W.derive_one(x["record_id"], "", "", x["http_head"], x["payload"] or "", x["payload_digest"], x["payload_length"], x["warc_head"])]
    assert [r["header"] + r["block"] for r in made.collect()] == [r["header"] + r["block"] for r in records]
    assert records[0]["source_digest"] == "sha1:GIVEN" and "WARC-Refers-To-Payload-Digest: sha1:GIVEN\r\n" in records[1]["header"]
    assert f"source-payload-length: {len(latin)}\r\n" in records[0]["block"] and "source-warc-header: warc-ip-address: 192.0.2.1\r\n" in records[0]["block"]


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, None, None), (None, "<a>", "", "", "", "x", "y"), (2, "<b>", "http://[bad", "h", "<a href='http://[bad2'>x</a>" + "<p>w " * 100_000, None, None)] * 2
    got = derive(spark, rows).collect()
    assert len(got) == 12 and len({r["record_id"] for r in got}) == 6
    assert all(r["block_digest"] == sha(r["block"].encode()) for r in got)
    assert derive(spark, []).count() == 0


def test_query_covers_all_pages(spark):
    got = queries.op1_warc_derivatives(spark, "/root/testdata/sf0.001")
    assert got.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert random.Random(1).choice(got.select("header").collect())[0].startswith("WARC/1.1\r\nWARC-Type: ")


def test_parse_broken_files():
    """Cut, damaged and padded files give their whole records and no error."""
    record = lambda block, length: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + length + b"\r\n\r\n" + block + b"\r\n\r\n"
    one, two = record(b"one", b"3"), record(b"two!", b"4")
    blocks = lambda data: [b for _, b in W.parse(data)]
    assert blocks(one + two) == [b"one", b"two!"] and blocks(b"") == []
    assert blocks(one + two[:20]) == [b"one"] and blocks(one + two[:-6]) == [b"one"]
    assert blocks(record(b"bad", b"x") + two) == [b"two!"] and blocks(record(b"bad", b"-1") + two) == [b"two!"]
    packed = gzip.compress(one) + gzip.compress(two)
    assert blocks(packed) == blocks(packed + b"\0\0\0") == [b"one", b"two!"]
    assert blocks(gzip.compress(one + two)) == [b"one", b"two!"]
    assert blocks(packed[:-30]) == [b"one"]
    assert blocks(gzip.compress(one) + b"\x1f\x8b\x08garbage") == [b"one"]


def test_facts_of_unclosed_tags_take_linear_time():
    for tag in ("<title>", "<a href ", "<a href=\"x", "<title "):
        start = time.perf_counter()
        W.page_facts(tag * (2_000_000 // len(tag)), "http://a.example/")
        assert time.perf_counter() - start < 10, tag


def test_facts_against_plain_patterns():
    rnd, title = random.Random(4), re.compile(r"<title(?=[\s/>])[^>]*>(.*?)</title\s*>", re.S | re.I)
    href = re.compile(r"""<a(?=[\s/])[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
    parts = ["<a ", "<A/", "href", "href=", " = ", '"', "'", ">", "x", "y ", "<title", "<title>", "</title >", " ", "<p>", "data-href=z"]
    for _ in range(20_000):
        page = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 18)))
        assert [m.groups() for m in W._hrefs(page)] == [m.groups() for m in href.finditer(page)], page
        facts = dict(W.page_facts(page, "http://a.example/"))
        assert facts.get("title") == ((" ".join(m[1].split())) if (m := title.search(page)) else None), page
