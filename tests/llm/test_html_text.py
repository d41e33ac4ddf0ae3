import pytest

from toponymic.llm import html_text, queries
from toponymic.llm.html_text import page_text

CASES = [
    ("", ""), (None, ""), ("plain", "plain"), ("a  b\n\tc", "a b c"), ("a < b & c &lt; &#233;&eacute;&nbsp;x", "a < b & c < éé\xa0x"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>one</div><div>two</div>three", "one\ntwo\nthree"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>bold</b>er <i> and</i> on", "bolder and on"), ("<p>a <b>b</p>c</b>", "a b\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "* a\n* b\n  * c\n* d\n\ne"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<ol><li><p>a<p>b</ol>", "1. a\n\n   b"),
    ("<pre>\n a\n\n  b </pre>c", " a\n\n  b\n\nc"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>a<b</script>y", "xy"),
    ("<title>t</title>text", "text"), ("<p hidden>a</p><p style='Display: none'>b</p><p style=\"visibility:hidden\">c</p>d", "d"),
    ("<input type=hidden value=x>a<template>b</template><noscript>c</noscript>", "a"), ("a<!-- <p>b -->c<!DOCTYPE x>d<?php e?>f", "acdf"),
    ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>", "s\nt\ny"),
    ("<textarea>a <b> c</textarea>", "a <b> c"), ("<p>a</p", "a"), ("a<b", "a"), ("1<2 and 3<", "1<2 and 3<"), ("</p>a</div>", "a"),
    ("<SCRIPT>var t='</p>';</SCRIPT >b", "b"), ("<a href='x>y'>link</a>", "link"), ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
    ("<blockquote>a<p>b</blockquote>", "    a\n\n    b"), ("<p>x<table><tr><td>a</table>y", "x\n\na\n\ny"), ("a<hr>b<img alt=z>", "a\nb"),
    ("<select><option>a<option>b</select>c", "c"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert page_text(page) == want


def test_tables():
    page = ("<table><caption>Prices</caption><thead><tr><th>Fruit<th>Price<th>Note<tbody><tr><td>apple<td>3<td><td>z"
            "<tr><td>kiwi and pear<td>10<td>two<br>lines<tr><td colspan=2>total of all<td>13<tr><td rowspan=2>a<td>b<tr><td>c</table>")
    assert page_text(page).split("\n") == [
        "Prices", "Fruit          Price  Note", "apple          3             z", "kiwi and pear  10     two",
        "                      lines", "total of all          13", "a              b", "               c"]
    long = "w" * 100
    assert page_text(f"<table><tr><td>{long}<td>x<tr><td>a<td>y</table>") == f"{long}  x\na  y"     # shown whole, pads nothing
    nested = "<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd<td>e</table><td>f</table>"
    assert page_text(nested) == "a  b   c  f\n   dd  e"


def test_no_visible_word_is_lost_and_depth_has_no_limit():
    assert page_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert page_text("<ul><li>" * 500 + "deep").endswith("* deep")
    assert page_text("<table><tr><td>" * 200 + "deep").strip() == "deep"
    words = [f"w{i}" for i in range(2000)]
    page = "".join(f"<{t}>{w} " for w, t in zip(words, ["p", "td", "li", "b", "table", "div", "tr", "h2", "ul", "i"] * 200))
    assert sorted(page_text(page).replace("*", " ").split()) == sorted(words)


def test_operator_and_query(spark, tmp_path):
    rows = [(i, "u", page, "x") for i, (page, _) in enumerate(CASES)] + [(None, None, "<p>a", None), (0, "u", CASES[0][0], "x"),
                                                                           (900, "u", "<p>word " * 50000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op6_page_text(spark, str(tmp_path)).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted(
        (str(r[0]), page_text(r[2]), len(page_text(r[2]))) for r in rows)
    assert html_text.visible_text(df.limit(0)).collect() == []
