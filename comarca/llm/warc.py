"""Derive metadata and conversion records from WARC response records.

``responses`` frames stored pages as response records: an HTTP message as the block, its
digests (SHA-1, base 32) and a record id that follows from the target and the digest.
``derive`` makes two records of each response that is HTML:

* ``conversion``: the plain text, with WARC-Refers-To the response, WARC-Target-URI and
  WARC-Date of the source and the digest of its own block;
* ``metadata``: title, language, links (resolved against the target) and the source's
  HTTP headers and payload digest, as ``application/warc-fields``.

Both refer to the response and name each other (WARC-Concurrent-To).  ``record_bytes``
writes records in WARC/1.1 form.  Everything is made row by row: there is no shuffle.

Text is what stands outside comments, script, style, template, svg, iframe and head; block
elements end a line, runs of blanks are one, character references are decoded; unclosed and
crossed tags are taken as they come.  As in HTML, a head ends at its end tag or before the
first text or element that cannot stand in it.  Only a comment, script or style without an
end runs to the end of the page; a template, svg or iframe that is self-closed or has no end
tag hides nothing.  Nothing is run or loaded, so noscript, object, textarea and select are text.

Pages are read in linear time, whatever their length and however broken their tags are.

Defined results: a NULL html is an empty payload (its conversion is empty); a NULL url
gives records without target (relative links stay as they are); repeated rows give equal
records with equal ids; an empty table gives none; clashing columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import html as references
import re
import uuid
from bisect import bisect_left
from functools import cached_property
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import map_slices

#: Elements whose content is no text, and elements that end a line.
HIDDEN = ("script", "style", "template", "svg", "iframe")
TO_THE_END = ("script", "style")
BLOCKS = frozenset(("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr li main nav ol p pre section table tbody td tfoot th thead tr ul title body").split())
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORD = ("record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, "
          "content_type string, block binary, block_digest string, payload_digest string, source_headers string, source_digest string")

_OPEN = re.compile(rf"<!--|<!\[CDATA\[|<[!?]|<({'|'.join(HIDDEN)}|head)(?=[\s/>])", re.I)
#: What can stand in a head, besides blanks, by its beginning.
_IN_HEAD = re.compile(r"\s+|<!--|<[!?]|<(script|style|title|noscript|template|noframes)(?=[\s/>])|</?(?:base|basefont|bgsound|link|meta)(?=[\s/>])", re.I)
_HEAD_END = re.compile(r"</head(?=[\s/>])", re.I)
#: The rest of a tag without < or > in its quotes; what does not look like that is read from the marks of a page.
_PLAIN = r"(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+>"
_PLAIN_REST = re.compile(_PLAIN)
_TAG = re.compile(rf"</?([a-zA-Z][a-zA-Z0-9]*)\b({_PLAIN})?")
_ELEMENT = re.compile(r"<(area|a|img|link|iframe|script|form)\b", re.I)
_PLAIN_ADDRESS = re.compile(r"(?:[^<>\"'\s]++|\"[^\"<>]*+\"|'[^'<>]*+'|\s(?!(?:href|src|action)\s*=))*+"
                            r"(?:\s(href|src|action)\s*=\s*(\"[^\"<>]*+\"|'[^'<>]*+'|[^\s<>\"']++(?=[\s>]))|>)", re.I)
_ADDRESS = re.compile(r"\s(href|src|action)(?=\s*=)", re.I)
_VALUE = re.compile(r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title", re.I)
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang(?=\s*=\s*[\"']?([A-Za-z0-9-]+))", re.I)


class Page:
    """A page whose tags are read in linear time, however broken it is.

    Read from a place outside quotes, a tag ends at the first ``>``; a quote is passed over
    to its mate, and without a mate there is no tag.  Where reading from each of these
    characters ends is worked out once, from the last to the first.
    """

    def __init__(self, page: str):
        self.page = page
        self._none: dict[str, int] = {}

    @cached_property
    def _marks(self) -> list[int]:
        return [m.start() for m in re.finditer("[>\"']", self.page)]

    @cached_property
    def _ends(self) -> list[int]:
        return self._read(self._marks, lambda place: place + 1)

    @cached_property
    def _held(self) -> dict[int, tuple[str, re.Match]]:
        """Attributes that hold an address, by their place, quoted or not."""
        return {found.start(): (found[1], value) for found in _ADDRESS.finditer(self.page) if (value := _VALUE.match(self.page, found.end()))}

    @cached_property
    def _addressed(self) -> tuple[list[int], list[int]]:
        """Places of marks and such attributes, and the first attribute that reading from each comes to."""
        marks = sorted([*self._marks, *self._held])
        return marks, self._read(marks, lambda place: place if place in self._held else -1)

    def _read(self, marks: list[int], answer) -> list[int]:
        """What reading from each of the marks gives: ``answer`` of the first that is no quote, or -1."""
        ends, mate = [-1] * len(marks), {}
        for i in range(len(marks) - 1, -1, -1):
            what = self.page[marks[i]]
            if what == '"' or what == "'":
                if (j := mate.get(what)) is not None and j + 1 < len(marks):
                    ends[i] = ends[j + 1]
                mate[what] = i
            else:
                ends[i] = answer(marks[i])
        return ends

    def tag_end(self, at: int) -> int:
        """The place after the tag that goes on at ``at``, or -1."""
        if plain := _PLAIN_REST.match(self.page, at):
            return plain.end()
        i = bisect_left(self._marks, at)
        return self._ends[i] if i < len(self._ends) else -1

    def rest(self, at: int) -> int:
        """The same; where quotes do not match, the place after the next ``>``."""
        end = self.tag_end(at)
        return end if end >= 0 else self.find(">", at) + 1 or -1

    def find(self, text: str, at: int) -> int:
        """``str.find``, which looks for what is not there once only."""
        if at >= self._none.get(text, len(self.page) + 1):
            return -1
        found = self.page.find(text, at)
        if found < 0:
            self._none[text] = at
        return found

    def closed(self, name: str, at: int, blanks_only: bool = False) -> int:
        """The place after the next end tag of an element, or -1; ``blanks_only``: one that holds no more than its name."""
        key = f"/{name}{blanks_only}"
        if at >= self._none.get(key, len(self.page) + 1):
            return -1
        found = re.compile(rf"</{name}\s*>" if blanks_only else rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
        end = -1 if not found else found.end() if blanks_only else self.find(">", found.end()) + 1 or -1
        if end < 0:
            self._none[key] = at
        return end

    def head_end(self, at: int) -> int:
        """Where a head that has begun before ``at`` ends: at its end tag or before what cannot stand in it."""
        page = self.page
        while found := _IN_HEAD.match(page, at):
            what, name, start = found[0].lower(), (found[1] or "").lower(), found.end()
            if what.isspace():
                at = start
                continue
            if what == "<!--":
                end = self.find("-->", start) + 3
                at = end if end > 2 else len(page)
                continue
            end = (self.find(">", start) + 1 or -1) if what in ("<!", "<?") else self.tag_end(start) if name not in ("", *TO_THE_END) else self.rest(start)
            if end < 0:
                break
            if name in TO_THE_END:
                closed = self.closed(name, end)
                at = closed if closed >= 0 else len(page)
            elif name == "title":
                closed = self.closed(name, end, True)
                at = closed if closed >= 0 else self.find("<", end) if self.find("<", end) >= 0 else len(page)
            elif name:
                closed = self.closed(name, end, True)
                at = closed if closed >= 0 else end
            else:
                at = end
        if found := _HEAD_END.match(page, at):
            end = self.find(">", found.end()) + 1
            at = end or at
        return at

    def without_hidden(self) -> str:
        """The page with a blank for each comment, declaration and hidden element."""
        page, out, at = self.page, [], 0
        while found := _OPEN.search(page, at):
            out.append(page[at:found.start()])
            name, start = (found[1] or "").lower(), found.end()
            if not name:
                end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0].upper(), ">")
                upto = self.find(end, start)
                if upto < 0 and end == "]]>":
                    end, upto = ">", self.find(">", start)
                at = upto + len(end) if upto >= 0 else len(page) if end == "-->" else start
            elif (rest := self.rest(start)) < 0:
                at = start  # no tag
            elif name == "head":
                at = self.head_end(rest)
            else:
                at, open_ = rest, name in TO_THE_END or page[rest - 2:rest] != "/>"
                closed = self.closed(name, at) if open_ else -1
                if closed >= 0:
                    at = closed
                elif name in TO_THE_END:
                    at = len(page)
            out.append(page[found.start():at] if at == start else " ")
        return "".join([*out, page[at:]])

    def without_tags(self) -> str:
        """The page with a line end for each tag of a block and nothing for other tags."""
        out, at, page = [], 0, self.page
        while found := _TAG.search(page, at):
            end = found.end() if found[2] else self.tag_end(found.end())
            if end < 0:
                out.append(page[at:found.start() + 1])
                at = found.start() + 1
                continue
            out.append(page[at:found.start()] + ("\n" if found[1].lower() in BLOCKS else ""))
            at = end
        return "".join([*out, page[at:]])

    def addresses(self) -> list[tuple[str, str, str]]:
        """(element, attribute, value as written) of the first address in each tag that has one."""
        page, out, at = self.page, [], 0
        while found := _ELEMENT.search(page, at):
            at = found.end()
            if plain := _PLAIN_ADDRESS.match(page, at):
                if plain[1]:
                    out.append((found[1], plain[1], plain[2]))
                    at = plain.end()
                continue
            marks, first = self._addressed
            i = bisect_left(marks, at)
            if i < len(first) and first[i] >= 0:
                attribute, value = self._held[first[i]]
                out.append((found[1], attribute, value[1]))
                at = value.end()
        return out

    def title(self) -> str | None:
        found = _TITLE.search(self.page)
        if not found or (start := self.find(">", found.end()) + 1) == 0:
            return None
        end = _TITLE_END.search(self.page, start)
        return self.page[start:end.start() if end else len(self.page)]

    def language(self) -> str | None:
        """The last language that the first html tag with one names."""
        at = 0
        while found := _HTML.search(self.page, at):
            end = self.find(">", found.end())
            end = end if end >= 0 else len(self.page)
            named = None
            for named in _LANG.finditer(self.page, found.end(), end):
                pass
            if named:
                return named[1]
            at = end
        return None


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same id."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=4)}>"


def plain_text(page: str) -> str:
    shown = Page(Page(page).without_hidden().replace("\r", " ").replace("\n", " ")).without_tags()
    lines = (" ".join(references.unescape(line).split()) for line in shown.split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str, target: str | None) -> list[tuple[str, str]]:
    """(element@attribute, absolute address) in the order of the page."""
    out = []
    for element, attribute, value in Page(re.sub(r"<!--.*?(?:-->|\Z)", " ", page, flags=re.S)).addresses():
        address = references.unescape(value.strip("\"'").strip())
        try:
            address = urljoin(target or "", address)
        except ValueError:
            pass  # not an address: as it stands
        out.append((f"{element.lower()}@{attribute.lower()}", address))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of stored pages (url, html): target_uri, warc_date, http_headers, payload."""
    payload = F.coalesce("html", F.lit(""))
    head = F.format_string(HTTP_HEAD.replace("{}", "%d"), F.octet_length(payload))
    return pages.select(F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_headers"),
                        payload.alias("payload"), "page_id")


def derive(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Conversion and metadata records of response records, with the columns of RECORD."""
    inputs = ["target_uri", "warc_date", "http_headers", "payload"]

    def start():
        def records(target: str | None, date: str | None, head: str | None, page: str | None) -> list[dict]:
            page, head, date = page or "", head or "", date or DATE
            raw = page.encode("utf-8", "surrogatepass")
            block = head.encode("utf-8", "surrogatepass") + raw
            payload_digest, source = digest(raw), record_id("response", target or "", date, digest(block))
            ids = {kind: record_id(kind, source) for kind in ("conversion", "metadata")}
            text = plain_text(page).encode("utf-8", "surrogatepass")
            fields = [("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Block-Digest", digest(block)),
                      ("conversion", ids["conversion"])]
            read = Page(page)
            if (title := read.title()) is not None:
                fields.append(("title", " ".join(references.unescape(title).split())))
            if lang := read.language():
                fields.append(("lang", lang))
            for line in head.split("\r\n"):
                if ":" in line:
                    name, value = line.split(":", 1)
                    fields.append((f"http-{name.strip().lower()}", value.strip()))
            fields += [("outlink", f"{address} {where}") for where, address in links(page, target)]
            meta = "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in fields).encode("utf-8", "surrogatepass")
            both = []
            for kind, content_type, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
                both.append({"record_type": kind, "record_id": ids[kind], "refers_to": source,
                             "concurrent_to": ids["metadata" if kind == "conversion" else "conversion"], "target_uri": target,
                             "warc_date": date, "content_type": content_type, "block": body, "block_digest": digest(body),
                             "payload_digest": digest(body), "source_headers": head, "source_digest": payload_digest})
            return both

        kind = pa.list_(pa.struct([(c.split()[0], pa.binary() if c.split()[1] == "binary" else pa.string()) for c in RECORD.split(", ")]))

        def make(*columns: pa.Array) -> list[pa.Array]:
            return [pa.array([records(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)]
        return make

    struct = "records array<struct<" + ",".join(c.replace(" ", ":") for c in RECORD.split(", ")) + ">>"
    keep = ["page_id"] if keep is None else keep
    return map_slices(responses.select(*keep, *inputs), inputs, struct, start).select(*keep, F.inline("records"))


def record_bytes(records: DataFrame) -> DataFrame:
    """Add ``record``: each record as it stands in a WARC/1.1 file."""
    def line(name: str, column: str):
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), column, F.lit("\r\n"))).otherwise("")

    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
                    line("WARC-Concurrent-To", "concurrent_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"),
                    line("WARC-Block-Digest", "block_digest"), line("WARC-Payload-Digest", "payload_digest"), line("Content-Type", "content_type"),
                    F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n")))
    return records.withColumn("record", F.concat(F.encode(head, "UTF-8"), F.col("block"), F.encode(F.lit("\r\n\r\n"), "UTF-8")))
