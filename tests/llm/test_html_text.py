import html
import re

import pytest

from shelfmark.llm.html_text import events, extract, render
from shelfmark.llm.queries import op7_html_text
from conftest import SMALL

CASES = [
    ("<p>a<p>b  c<br>d</p>e", "a\n\nb c\nd\n\ne"),
    ("<ul><li>x<li>y<ol start=3><li>p<li value=7>q<li>r</ol></ul>z", "* x\n* y\n  3. p\n  7. q\n  8. r\n\nz"),
    ("<table><tr><th>Name<th>Age<tr><td>Bo<td>7<tr><td>Alexander<td>33</table>", "Name       Age\nBo         7\nAlexander  33"),
    ("<table><tr><td colspan=2>wide heading over both<tr><td>a<td>b<tr><td>ccc<td>d</table>", "wide heading over both\na    b\nccc  d"),
    ("<table><tr><td>one<br>two<td>x</table>", "one  x\ntwo"),
    ("<table><td>a<table><tr><td>in<td>ner</table><td>b\n</table>", "a        b\nin  ner"),
    ("<table><caption>cap</caption><tbody><tr><td>1</tbody></table>after", "cap\n1\n\nafter"),
    ("<div style='display:none'>no<b>no</b></div>yes<span hidden>no</span> ok", "yes ok"),
    ("<div style='x:y; DISPLAY : NONE'><p>no<div>no</div></div><input type=hidden>yes", "yes"),
    ("<script>if(a<b){x='</p>'}</script>t<!-- c --><style>p{}</style>", "t"),
    ("a &lt; b &amp;amp &copy; 3 < 4 x<y", "a < b &amp © 3 < 4 x"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<html><head><title>t</title><body>b", "b"),
    ("<title>t</title>shown<noscript>no</noscript>", "shown"),
    ("", ""),
    (" \n ", ""),
    ("<a href='x", ""),
    ("text <a href=", "text"),
    ("foo<br><br>bar", "foo\n\nbar"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
    ("<li>lone</li>x", "* lone\nx"),
    ("</p>a</div>b", "ab"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<b>bo</b>ld <i> it</i>", "bold it"),
    ("<p>1<table><tr><td>2</td></tr></table>3", "1\n\n2\n\n3"),
    ("x<!-- open", "x"),
    ("x<!-->y--><!doctype html>z<?php a?>", "xy-->z"),
    ("<a title='1>2'>in</a> <A HREF=\"</a>\">side</A>", "in side"),
    ("<textarea><b>&amp;</b></textarea>", "<b>&</b>"),
    ("a&nbsp;&nbsp;b", "a  b"),
    ("<h1>T</h1><h2>U</h2>v", "T\n\nU\n\nv"),
    ("<select><option>a<option>b</select>", "a\nb"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page", [c[0] for c in CASES] + ["<table><tr><p>a</table>b", "<td>x</b></tr>", "<p><ul><li></p></ul>" * 3])
def test_events_nest(page):
    open_now = []
    for kind, name, _ in events(page):
        if kind == "open":
            open_now.append(name)
        elif kind == "close":
            assert open_now.pop() == name
    assert not open_now


def test_any_depth_and_length():
    n = 20_000
    assert render("<div>" * n + "x" + "</div>" * n) == "x"
    assert render("<ul><li>" * 300 + "x").split()[-1] == "x"
    assert render("<p>a" * n).count("a") == n
    assert render('<a "' * n + ">b") == "b"


def visible_words(page):
    """Words outside of what is never shown, by taking the page apart with patterns."""
    page = re.sub(r"(?s)<!--.*?(-->|$)", "", page)
    page = re.sub(r"(?is)<(script|style|title)\b.*?(</\1\s*>|$)", "", page)
    page = re.sub(r"(?i)</?(b|a|i|em|span)\b[^>]*>", "", page)
    page = re.sub(r"<[^>]*(>|$)", " ", page)
    return html.unescape(page).replace("\xa0", " ").split()


def test_all_visible_words_of_the_table(spark):
    rows = op7_html_text(spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet"), "page_id").collect()
    assert len(rows) == 50
    for r in rows:
        words = [w for w in r["text"].split() if w != "*"]
        assert words == [w for w in visible_words(r["html"]) if w != "*"]
        assert r["n_chars"] == len(r["text"]) and r["n_lines"] == len(r["text"].split("\n"))


def test_odd_rows(spark):
    rows = [(1, None, "old", 1), (2, "", "old", 2), (3, "<p>x", "old", 3), (3, "<p>x", "old", 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    found = extract(df)
    assert found.columns == ["page_id", "n_chars", "text"]
    assert sorted((r["page_id"], r["text"]) for r in found.collect()) == [(1, None), (2, ""), (3, "x"), (3, "x")]
    assert extract(df.where("page_id < 0")).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"),
        ("<math><semantics><mi>y</mi><annotation>no</annotation></semantics></math>", "y"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><g><text>yes</text></g></svg>", "yes"),
        ("<svg><defs/><title/><path d='M 0'/><text>a</text><text>b</text></svg>c", "a\nb\nc"),
        ("<svg><text display=none>no</text><metadata>no</metadata></svg><desc>yes</desc>", "yes"),
        ("a<svg/>b", "ab"),
        ("<input type=submit value='Send it'><input type=BUTTON value=Stop>", "Send it Stop"),
        ("<input value=typed><input type=password value=no><input type=checkbox value=no>", "typed"),
        ("<input type=submit value=no hidden><input type=' Hidden ' value=no>yes", "yes"),
    ],
)
def test_formulas_drawings_and_buttons(page, text):
    assert render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>b1<td>c1<tr><td>b2<td>c2</table>", "A  b1  c1\n   b2  c2"),
        ("<table><tr><td>a<td rowspan=2>B<tr><td>c<tr><td>d<td>e</table>", "a  B\nc\nd  e"),
        ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
        ("<table><thead><tr><td rowspan=9>A<td>b<tbody><tr><td>c<td>d</table>", "A  b\nc  d"),
        ("<table><tr><td rowspan=2 colspan=2>A<td>b<tr><td>c<tr><td>dd<td>e<td>f</table>", "A      b\n       c\ndd  e  f"),
        ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<details>no<summary>sum <b>up</b></summary>no<p>no</p><summary>no</summary></details>yes", "sum up\nyes"),
        ("<details open>a<summary>s</summary>b</details>", "a\ns\nb"),
        ("<details><p>no</details><details><summary>t<details>no<summary>u</details></summary>no</details>", "t\nu"),
        ("<p style='visibility:hidden'>no<b style='visibility: VISIBLE'>yes</b>no<br>no</p>z", "yes\n\nz"),
        ("<div style='visibility:hidden'><i style='visibility:inherit'>no</i><input value=no></div>z", "z"),
        ("<div style='display:none'><b style='visibility:visible'>no</b></div>z", "z"),
        ("<table><tr><td style='visibility:hidden'>a<td>b<tr><td>c<td>d</table>", "   b\nc  d"),
        ("<svg visibility=hidden><text>no</text><text visibility=visible>yes</text></svg>", "yes"),
    ],
)
def test_rows_dialogs_details_and_visibility(page, text):
    assert render(page) == text


def test_long_spans():
    cells = "".join(f"<td rowspan=65534>{i}" for i in range(200))
    page = f"<table><tr>{cells}" + "<tr><td>x" * 2000 + "</table>"
    assert render(page).split().count("x") == 2000
