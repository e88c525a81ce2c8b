"""WARC derivatives: a metadata and a plain-text conversion record for every response.

Both records refer to their response (WARC-Refers-To), repeat its target, date and
payload digest, and name each other (WARC-Concurrent-To). The metadata record keeps
the response's own headers, its digests, and what the page says about itself: title,
language and outgoing links. The conversion record holds the page's visible text.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Output rows gathered to a batch: so many characters of blocks.
BATCH_CHARS = 4_000_000
#: Fixed: elements whose content is not text, and elements that end a line.
HIDDEN = ("script", "style", "template", "noscript", "head", "iframe", "svg", "math", "object")
LINES = ("address", "article", "aside", "blockquote", "br", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
         "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "td", "th", "tr", "ul")

#: Hidden elements that only their end tag closes; without it they reach to the end of the page.
RAW = ("script", "style", "noscript", "iframe")

#: The end of a whole tag name.
_NAME = r"(?=[\s/>])"
_OPEN = re.compile(r"<!--|<(" + "|".join(HIDDEN) + ")" + _NAME + r"[^>]*>|<[!?][^>]*>", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
#: What a head can hold; its end tag, or else the first other tag or text, ends it.
_HEAD = re.compile(r"\s+|<!--.*?(?:-->|\Z)|<(script|style|noscript)" + _NAME + r"[^>]*>.*?(?:</\1\s*>|\Z)|<(title|template)" + _NAME + r"[^>]*>(?:.*?</\2\s*>|[^<]*)"
                   r"|<(?:meta|link|base|basefont|bgsound)" + _NAME + r"[^>]*>|</(?!(?:head|body|html|br)[\s/>])[a-z][^>]*>|<[!?][^>]*>", re.S | re.I)
_BREAK = re.compile(r"</?(?:" + "|".join(LINES) + ")" + _NAME + r"[^>]*>", re.I)
_ANY = re.compile(r"</?[a-zA-Z][^>]*>")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
_TITLE, _TITLE_END = re.compile("<title" + _NAME + "[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_SCRIPT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)" + _NAME + r"[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_LINK, _HREF = re.compile(r"<a(?=[\s/])", re.I), re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")


def _shown(markup: str) -> str:
    """``markup`` without comments, declarations and hidden elements.

    A head ends where its end tag is missing, too; svg and math may close themselves; of
    other hidden elements without an end tag all but ``RAW`` lose the tag only.
    """
    out, at, unclosed = [], 0, set()
    while m := _OPEN.search(markup, at):
        out.append(markup[at:m.start()])
        at, name = m.end(), (m[1] or "").lower()
        if m[0] == "<!--":
            end = markup.find("-->", at)
            at = end + 3 if end >= 0 else len(markup)
        elif name == "head":
            while item := _HEAD.match(markup, at):
                at = item.end()
            if end := _CLOSE[name].match(markup, at):
                at = end.end()
        elif name and name not in unclosed and not (name in ("svg", "math") and m[0].endswith("/>")):
            if end := _CLOSE[name].search(markup, at):
                at = end.end()
            elif name in RAW:
                at = len(markup)
            else:
                unclosed.add(name)
    return "".join(out) + markup[at:]


def visible_text(markup: str) -> str:
    """The text a reader sees: one line per block element, character references resolved."""
    text = _ANY.sub("", _BREAK.sub("\n", _shown(markup.replace("\r", "\n").replace("\n", " "))))
    text = _SPACE.sub(" ", html.unescape(text))
    return _LINES.sub("\n", text).strip()


def _hrefs(plain: str) -> Iterator[re.Match]:
    """The value of each link's first href that has one; every tag is read once."""
    at = 0
    while tag := _LINK.search(plain, at):
        at = plain.find(">", tag.end())
        at = len(plain) if at < 0 else at
        for name in _HREF.finditer(plain, tag.end(), at):
            if value := _VALUE.match(plain, name.end()):
                at = value.end()
                yield value
                break


def page_facts(markup: str, target: str) -> list[tuple[str, str]]:
    """Title, language and outgoing links (resolved, each once, in order)."""
    plain = _SCRIPT.sub(" ", markup)
    out = []
    # the first end tag after the first title; where that has none, no later one has
    if (m := _TITLE.search(plain, 0, plain.rfind(">") + 1)) and (end := _TITLE_END.search(plain, m.end())):
        out.append(("title", " ".join(html.unescape(plain[m.end():end.start()]).split())))
    if m := _LANG.search(plain):
        out.append(("language", m[1]))
    links = {}
    for m in _hrefs(plain):
        link = html.unescape(m[1] or m[2] or m[3] or "").strip()
        try:
            links[urljoin(target, link)] = None
        except ValueError:  # not a url
            links[link] = None
    return out + [("outlink", " ".join(link.split())) for link in links if link]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(response_id: str, kind: str) -> str:
    """The same id for the same response and kind, whenever it is derived."""
    h = hashlib.sha256(f"{kind}\n{response_id}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def derive_one(response_id: str, target: str, date: str, http_head: str, payload: str, given_digest: str = "", length: int = -1, warc_head: str = "") -> list[dict]:
    """The two records of a response; digest and length are the payload's as UTF-8 where none are given."""
    body = payload.encode("utf-8", "surrogatepass")
    source_digest = given_digest or digest(body)
    ids = {k: derived_id(response_id, k) for k in ("metadata", "conversion")}
    fields = [("source-payload-digest", source_digest), ("source-payload-length", str(len(body) if length < 0 else length)),
              *[("source-warc-header", h) for h in warc_head.splitlines() if h.strip()], *[("source-header", h) for h in http_head.splitlines() if h.strip()], *page_facts(payload, target)]
    blocks = {"metadata": "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields), "conversion": visible_text(payload)}
    out = []
    for kind, other, content in (("metadata", "conversion", "application/warc-fields"), ("conversion", "metadata", "text/plain; charset=utf-8")):
        block = blocks[kind].encode("utf-8", "surrogatepass")
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", response_id), ("WARC-Concurrent-To", ids[other]),
                   ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Refers-To-Payload-Digest", source_digest), ("WARC-Block-Digest", digest(block)),
                   ("Content-Type", content), ("Content-Length", str(len(block)))]
        out.append({"record_type": kind, "record_id": ids[kind], "refers_to": response_id, "concurrent_to": ids[other], "target_uri": target,
                    "source_digest": source_digest, "block_digest": digest(block), "block_length": len(block),
                    "header": VERSION + "\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in headers if v), "block": blocks[kind]})
    return out


_KINDS = ("record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
          "source_digest string, block_digest string, block_length long, header string, block string")


def derive(responses: DataFrame, *, keep: str, record_id: Column, target: Column, date: Column, http_head: Column, payload: Column,
           payload_digest: Column | None = None, payload_length: Column | None = None, warc_head: Column | None = None) -> DataFrame:
    """Two rows per row of ``responses``: column ``keep``, and the record's type, ids, digests,
    ``header`` (the WARC header's lines) and ``block``.

    A map over the rows, nothing shuffled; output leaves a task in batches of about
    ``BATCH_CHARS`` characters. Null payload: an empty one. A null target, date or
    head: that header is absent. The source's payload digest, payload length and WARC headers
    are passed through; where they are null or not given, digest and length are those of
    the payload as UTF-8. A null record id counts as the empty one. Ids follow
    from the response's id alone, so repeated rows give equal records and a repeated run
    gives the same files. Empty table: empty result.
    """
    none = F.lit(None)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = responses.select(F.col(keep).alias("kept"), text(record_id).alias("i"), text(target).alias("t"), text(date).alias("d"), text(http_head).alias("h"), text(payload).alias("p"),
                            text(none if payload_digest is None else payload_digest).alias("g"), F.coalesce((none if payload_length is None else payload_length).cast("long"), F.lit(-1)).alias("n"),
                            text(none if warc_head is None else warc_head).alias("w"))
    kind = responses.schema[keep].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, chars = [], 0
            for kept, *response in frame.itertuples(index=False, name=None):
                for record in derive_one(*response):
                    out.append({keep: kept} | record)
                    chars += len(record["block"])
                if chars >= BATCH_CHARS:
                    yield pd.DataFrame(out)
                    out, chars = [], 0
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, f"`{keep}` {kind}, {_KINDS}")


def serialised(records: DataFrame) -> DataFrame:
    """``records`` with ``warc``: the record as it stands in a file."""
    crlf = F.lit("\r\n")
    return records.withColumn("warc", F.encode(F.concat("header", crlf, "block", crlf, crlf), "utf-8"))


def _inflated_members(data: bytes) -> Iterator[bytes]:
    """The members of a file compressed by record, one after another; what is not gzip ends them."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            yield member.decompress(data) + member.flush()
        except zlib.error:
            return
        data = member.unused_data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file, compressed by record or not.

    Of a compressed file one member at a time is held. A record that the file's end, or
    a damaged member, cuts off is left out, and so is one without a length; reading goes on at the next record.
    """
    held = b""
    for part in _inflated_members(data) if data[:2] == b"\x1f\x8b" else [data]:
        held, at = held + part, 0
        while (start := held.find(b"WARC/", at)) >= 0 and (end := held.find(b"\r\n\r\n", start)) >= 0:
            lines = held[start:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = headers.get("content-length", "0")
            if not (length.isascii() and length.isdigit()):
                at = end + 4
                continue
            if end + 4 + int(length) > len(held):
                break
            at = end + 4 + int(length)
            yield headers, held[end + 4:at]
        held = held[at:]


def _unchunked(body: bytes) -> bytes:
    """A body without chunked transfer coding; what does not look chunked stays as it is."""
    out, at = bytearray(), 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        out += body[m.end():m.end() + size]
        if not size:
            return bytes(out)
        at = m.end() + size
        at += 2 if body[at:at + 2] == b"\r\n" else 0
    return bytes(out) if at else body


def _inflated(body: bytes, wbits: int) -> bytes:
    """What can be decompressed, also of a body that is cut short."""
    out = bytearray()
    while body:
        one = zlib.decompressobj(wbits)
        for i in range(0, len(body), 1 << 16):
            try:
                out += one.decompress(body[i:i + (1 << 16)])
            except zlib.error:
                return bytes(out)
            if one.eof:
                break
        body = one.unused_data + body[i + (1 << 16):] if one.eof else b""
    return bytes(out)


def _plain(body: bytes, codings: list[str]) -> bytes | None:
    """A body without its content codings, the last one first; null where one is unknown here (br without its package)."""
    for coding in reversed(codings):
        if coding in ("gzip", "x-gzip"):
            body = _inflated(body, zlib.MAX_WBITS | 16) if body[:2] == b"\x1f\x8b" else body
        elif coding == "deflate":
            body = _inflated(body, zlib.MAX_WBITS) or _inflated(body, -zlib.MAX_WBITS)
        elif coding == "br":
            try:
                import brotli
            except ModuleNotFoundError:
                return None
            try:
                body = brotli.decompress(body)
            except brotli.error:
                return None
        elif coding not in ("", "identity"):
            return None
    return body


def _decoded(body: bytes, http_head: str) -> str:
    """A body's text by its byte order mark, its declared charset, its meta tag, or else as UTF-8."""
    found = _CHARSET.search(next(iter(_values(http_head, "content-type")), ""))
    meta = _META.search(body[:4096])
    declared = found[1] if found else meta[1].decode("latin-1") if meta else "utf-8"
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            body, declared = body[len(mark):], name
    if declared.lower() in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii"):
        declared = "cp1252"  # as browsers read it
    try:
        return body.decode(declared, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)
_META = re.compile(rb"""<meta\b[^>]*?charset\s*=\s*["']?([\w.:-]+)""", re.I)


def _values(http_head: str, name: str) -> list[str]:
    """The comma-separated values of a header, lower case."""
    lines = (x.partition(":") for x in http_head.split("\n")[1:])
    return [v.strip().lower() for k, _, vs in lines if k.strip().lower() == name for v in vs.split(",")]


def source_responses(files: DataFrame) -> DataFrame:
    """Responses in WARC files read by the ``binaryFile`` source: ``record_id, target, date, http_head, payload,
    payload_digest, payload_length, warc_head``.

    ``payload`` is the text, without transfer and content codings and decoded by its charset (null
    where a coding is unknown). The digest is the source's; where it gives none, that of the body
    without its transfer coding, which is what ``payload_length`` measures. ``warc_head`` has the WARC headers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for headers, block in parse(content):
                    if headers.get("warc-type") == "response":
                        raw, _, body = block.partition(b"\r\n\r\n")
                        head = raw.decode("latin-1")
                        if "chunked" in _values(head, "transfer-encoding"):
                            body = _unchunked(body)
                        plain = _plain(body, _values(head, "content-encoding"))
                        rows.append((headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), head, None if plain is None else _decoded(plain, head),
                                     headers.get("warc-payload-digest") or digest(body), len(body), "\r\n".join(f"{k}: {v}" for k, v in headers.items())))
                yield pd.DataFrame(rows, columns=["record_id", "target", "date", "http_head", "payload", "payload_digest", "payload_length", "warc_head"])

    return files.select("content").mapInPandas(run, "record_id string, target string, date string, http_head string, payload string, payload_digest string, payload_length long, warc_head string")


def responses(files: DataFrame) -> DataFrame:
    """``record_id, target, date, http_head, payload`` of ``source_responses``."""
    return source_responses(files).select("record_id", "target", "date", "http_head", "payload")


def page_responses(pages: DataFrame) -> DataFrame:
    """The ``pages`` table as responses: ids from the page's id and url, a plain HTTP head."""
    h = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    uuid = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    return pages.select("page_id", uuid.alias("record_id"), F.col("url").alias("target"), F.lit("2024-01-01T00:00:00Z").alias("date"), head.alias("http_head"), F.col("html").alias("payload"))
