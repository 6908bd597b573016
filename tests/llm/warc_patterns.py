"""The same reading of a page by backtracking patterns: plain, but quadratic on broken pages."""

import html as references
import re
from urllib.parse import urljoin

from comarca.llm.warc import BLOCKS, HIDDEN, TO_THE_END

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_OPEN = re.compile(rf"<!--|<!\[CDATA\[|<[!?]|<({'|'.join(HIDDEN)}|head)(?=[\s/>])", re.I)
_REST = re.compile(rf"{_ATTRIBUTES}>|[^>]*>")  # of a tag; the second if quotes do not match
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in HIDDEN}
#: What can stand in a head, piece by piece.
_IN_HEAD = re.compile(rf"\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style)(?=[\s/>])(?:{_ATTRIBUTES}>|[^>]*>).*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
                      rf"|<title(?=[\s/>]){_ATTRIBUTES}>(?:[^<]*</title\s*>|.*?</title\s*>|[^<]*)"
                      rf"|<(noscript|template|noframes)(?=[\s/>]){_ATTRIBUTES}>(?:.*?</\2\s*>)?"
                      rf"|</?(?:base|basefont|bgsound|link|meta)(?=[\s/>])(?:{_ATTRIBUTES}>|[^>]*>)", re.S | re.I)
_HEAD_END = re.compile(r"</head(?=[\s/>])[^>]*>", re.I)
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_LINK = re.compile(r"<(a|area|img|link|iframe|script|form)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\s(href|src|action)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)


def without_hidden(page: str) -> str:
    """The page with a blank for each comment, declaration and hidden element."""
    out, at, endless = [], 0, set()  # endless: elements without an end tag from here on
    while found := _OPEN.search(page, at):
        out.append(page[at:found.start()])
        name, start = (found[1] or "").lower(), found.end()
        if not name:
            end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0].upper(), ">")
            upto = page.find(end, start)
            if upto < 0 and end == "]]>":
                end, upto = ">", page.find(">", start)
            at = upto + len(end) if upto >= 0 else len(page) if end == "-->" else start
        elif not (rest := _REST.match(page, start)):
            at = start  # no tag
        elif name == "head":
            at = rest.end()
            while inside := _IN_HEAD.match(page, at):
                at = inside.end()
            if closed := _HEAD_END.match(page, at):
                at = closed.end()
        else:
            at, open_ = rest.end(), name in TO_THE_END or not rest[0].endswith("/>")
            closed = _END[name].search(page, at) if open_ and name not in endless else None
            if closed:
                at = closed.end()
            elif open_ and name in TO_THE_END:
                at = len(page)
            elif open_:
                endless.add(name)
        out.append(page[found.start():at] if at == start else " ")
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    shown = without_hidden(page)
    shown = _TAG.sub(lambda m: "\n" if m[1].lower() in BLOCKS else "", shown.replace("\r", " ").replace("\n", " "))
    lines = (" ".join(references.unescape(line).split()) for line in shown.split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str, target: str | None) -> list[tuple[str, str]]:
    """(element@attribute, absolute address) in the order of the page."""
    out = []
    for element, attribute, value in _LINK.findall(re.sub(r"<!--.*?(?:-->|\Z)", " ", page, flags=re.S)):
        address = references.unescape(value.strip("\"'").strip())
        try:
            address = urljoin(target or "", address)
        except ValueError:
            pass  # not an address: as it stands
        out.append((f"{element.lower()}@{attribute.lower()}", address))
    return out
