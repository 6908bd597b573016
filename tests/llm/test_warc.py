import base64
import hashlib
import random
import time
from html.parser import HTMLParser

import pytest

import warc_patterns
from comarca.llm import warc
from comarca.llm.queries import op8_warc_derivatives


def test_records_are_linked_and_digests_hold(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc.record_bytes(warc.derive(warc.responses(pages))).collect()
    assert len(records) == 2 * pages.count()
    by_id = {r.record_id: r for r in records}
    html = {r.page_id: (r.url, r.html) for r in pages.collect()}
    for r in records:
        other = by_id[r.concurrent_to]
        assert other.concurrent_to == r.record_id and other.refers_to == r.refers_to and other.record_type != r.record_type
        url, page = html[r.page_id]
        sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r.target_uri == url and r.block_digest == sha1(bytes(r.block)) and r.source_digest == sha1(page.encode())
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Refers-To"] == r.refers_to
        assert rest == bytes(r.block) + b"\r\n\r\n" and int(fields["Content-Length"]) == len(r.block)
        if r.record_type == "metadata":
            assert f"WARC-Source-Payload-Digest: {r.source_digest}" in bytes(r.block).decode()
    assert op8_warc_derivatives(spark, sf_dir).count() == len(records)


def test_text_and_links():
    page = ("<!DOCTYPE html><html lang='de-AT'><head><title>T &amp; U</title><style>p{}</style><script>var t='</p>';</script></head><body>"
            "<!-- <a href='no'>x</a> --><p>One <b>bo</b>ld &eacute;<br>two\n lines<p title='a > b'>three<div>four<script>x</div></body>")
    assert warc.plain_text(page) == "One bold é\ntwo lines\nthree\nfour"
    links = warc.links("<a class=x href='/a?b&amp;c'>1</a><img src=i.png><a href=\"http://[bad\">2</a><!-- <a href=no> -->", "http://h.example/d/e")
    assert links == [("a@href", "http://h.example/a?b&c"), ("img@src", "http://h.example/d/i.png"), ("a@href", "http://[bad")]
    assert warc.plain_text("") == "" and warc.plain_text("a < b & c") == "a < b & c"


def test_null_repeated_and_clashing_columns(spark):
    rows = [(1, None, None, "x"), (2, "http://a.example/", "", "x"), (3, "http://a.example/", "<p>t", "x"), (3, "http://a.example/", "<p>t", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 8
    conversions = {(r.page_id, bytes(r.block), r.record_id) for r in got if r.record_type == "conversion"}
    assert {(p, b) for p, b, _ in conversions} == {(1, b""), (2, b""), (3, b"t")} and len(conversions) == 3
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0


def test_left_out_and_self_closed_tags_hide_no_text():
    for page in ("<html><head><title>t</title><body><p>Hello</p>", "<html><head><meta charset=utf-8><title>t</title><p>Hello</p>",
                 "<head><script>if (a</* </head> */b) {}</script><link rel=x>\n<!-- </head> --></head><body>Hello",
                 "<head><noscript><style>p{}</style></noscript><title>t</title>Hello", "<head lang='>'><title>t</title></head>Hello", "<head>Hello",
                 "<svg width='1' />Hello<p><svg><title>no</title></svg>", "<iframe/>Hello", "<template/>Hello", "<svg><path d=x>Hello", "<iframe src=x>Hello",
                 "<template>no</template>Hello", "Hello<script>x", "Hello<style>x", "Hello<!-- x", "Hello<script src=a />no"):
        assert warc.plain_text(page) == "Hello", page
    assert warc.plain_text("<noscript>a</noscript><p><textarea>b</textarea><p><select><option>c</select><p><object>d</object>") == "a\nb\nc\nd"
    assert warc.plain_text("<header>a</header><svg-icon>b</svg-icon><p>c <![CDATA[x") == "a\nb\nc <![CDATA[x"


class Text(HTMLParser):
    """Another parser's idea of the text outside what is hidden."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in (*warc.HIDDEN, "head"):
            self.inside.append(tag)
        elif tag == "body":
            self.inside = []

    def handle_endtag(self, tag):
        if tag in self.inside:
            del self.inside[self.inside.index(tag):]

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)


def test_text_of_all_pages_by_another_parser(spark):
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    squeezed = lambda text: "".join(text.split())
    assert [squeezed(warc.plain_text(p)) for p in pages] == [squeezed("".join(Text(p).out)) for p in pages]
    assert len(pages) > 100


PIECES = ("<a| href|=|\"|'|>|<|/|<img src=x>|<title|<title>|</title>|</title >|<html| lang=de| lang = 'fr'|<head>|</head>|<body>|<script>|</script>|<script|</script|"
          "<style>|</style>|<!--|-->|<![CDATA[|]]>|<!x|<?y|<svg|/>|</svg>|<template>|</template>|<iframe src='q'>|</iframe>|<noscript>|</noscript>|<meta a=b>|<link|text| |"
          "\n|<p>|</p>|<br/>|&amp;|<form action=|<area|<base>|<noframes>|<b class=\"x\">|<header>| src = |lang=lang=").split("|")


@pytest.mark.parametrize("seed", range(4))
def test_broken_pages_against_plain_patterns(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        page = "".join(rng.choice(PIECES) for _ in range(rng.choice([3, 6, 10, 20, 40])))
        title, lang, read = warc_patterns._TITLE.search(page), warc_patterns._LANG.search(page), warc.Page(page)
        assert warc.plain_text(page) == warc_patterns.plain_text(page), page
        assert warc.links(page, "http://h.example/x") == warc_patterns.links(page, "http://h.example/x"), page
        assert read.title() == (title[1] if title else None) and read.language() == (lang[1] if lang else None), page


@pytest.mark.parametrize("piece", ["<a href", "<title ", "<html ", "<title>", "<svg ", "<script ", "</script ", "<head><title>x", "<![CDATA[", "<a x='", '<a "',
                                   "<img src='x", "<html lang", "<head></script ", "<a href=x ", "<!", "<template></template ", "<p <head><style>"])
def test_a_megabyte_of_unclosed_tags_in_linear_time(piece):
    page, start = piece * (1_000_000 // len(piece)), time.perf_counter()
    warc.plain_text(page)
    warc.links(page, None)
    warc.Page(page).title()
    warc.Page(page).language()
    assert time.perf_counter() - start < 10
