"""Metadata and tag text extraction: FIXTURES cases 12-17 and the paragraph rules."""

import pytest

from toponymic.operators.article_markup import article_fields, element_text, parse, with_article_fields, with_tag_text


def meta_of(spark, xml):
    return article_fields(xml)[1]


def test_year_and_pub_type(spark):                                       # 12
    m = meta_of(spark, '<front><pub-date pub-type="epub"><year>2013</year></pub-date></front>')
    assert (m["year"], m["pub_type"]) == (2013, "epub")


def test_year_without_pub_type_is_null(spark):                           # 13
    m = meta_of(spark, "<front><pub-date><year>2013</year></pub-date></front>")
    assert (m["year"], m["pub_type"]) == (None, None)


def test_only_first_pub_date(spark):                                     # 14
    m = meta_of(spark, '<front><pub-date pub-type="ppub"><month>3</month></pub-date>'
                       '<pub-date pub-type="epub"><year>2011</year></pub-date></front>')
    assert (m["year"], m["pub_type"]) == (None, None)


def test_no_front(spark):                                                # 15
    m = meta_of(spark, "<article><body><p>x</p></body></article>")
    assert m == {"year": None, "pub_type": None, "journal": None, "doi": None, "pmid": None}


def test_ids_by_attribute(spark):                                        # 16
    m = meta_of(spark, '<front><journal-title>Acta &amp; Co</journal-title>'
                       '<article-id pub-id-type="pmid">123</article-id>'
                       '<article-id pub-id-type="doi">10.1/abc</article-id></front>')
    assert (m["journal"], m["pmid"], m["doi"]) == ("Acta & Co", "123", "10.1/abc")


def test_doctype_and_unclosed_p(spark):                                  # 17
    xml = ('<!DOCTYPE article PUBLIC "-//NLM//DTD v3.0//EN" "journalpublishing3.dtd">'
           '<article><front><pub-date pub-type="epub"><year> 1999 </year></pub-date></front>'
           "<body><p>One <b>bold</b><p>Two</body></article>")
    df = spark.createDataFrame([(1, xml), (2, None)], "k int, markup string")
    rows = {r.k: r for r in with_article_fields(df, "markup").collect()}
    assert rows[1].meta.year == 1999
    assert rows[1].text == "One bold\n\nTwo\n\n"
    assert rows[2].text is None and rows[2].meta.year is None


@pytest.mark.parametrize("front, want", [
    ("<!-- <journal-title>Old</journal-title> --><journal-title>New</journal-title>", {"journal": "New"}),
    ("<article-id pub-id-type='doi'/><article-id pub-id-type='pmid'>5</article-id>", {"doi": None, "pmid": "5"}),
    ("<article-id x-pub-id-type='doi'>7</article-id>", {"doi": None}),
    ("<pub-date pub-type=\"e'pub\"><year>2001</year></pub-date>", {"year": 2001, "pub_type": "e'pub"}),
    ("<journal-title>S&#x000E3;o &eacute; &#233;</journal-title>", {"journal": "São é é"}),
    ("<pub-date pub-type='x'><year>MMI</year></pub-date>", {"year": None, "pub_type": None}),
    ("<journal-title></journal-title>", {"journal": None}),
])
def test_traps_in_front(spark, front, want):
    meta = meta_of(spark, f"<article><front>{front}</front><back><journal-title>no</journal-title></back></article>")
    assert {k: meta[k] for k in want} == want


@pytest.mark.parametrize("markup, want", [
    ("<p>A <list><list-item><p>B</p></list-item></list> then Nairobi, Kenya</p>", "A B then Nairobi, Kenya\n\nB\n\n"),
    ("<p>a <table><tr><td>x</td></tr></table> after</p>", "a x after\n\n"),
    ("<p>S&#x000E3;o Paulo, &#233;&eacute; &amp;lt;</p>", "São Paulo, éé &lt;\n\n"),
    ("<p>open <b>x<p>two</p></b>", "open x\n\ntwo\n\n"),
    ("<p>One <ul><li>a<li>b</ul>more", "One \n\n"),
    ("<p>a <b>b</p> c</b> <p>d", "a b\n\nd\n\n"),
    ("<p>x<![CDATA[ <y> ]]></p>", "x <y> \n\n"),
    ("<p a='>'>q</p>", "q\n\n"),
])
def test_paragraphs_keep_all_their_text(markup, want):
    assert element_text(markup) == want


@pytest.mark.parametrize("html, expected", [
    ("<p>a</p><p>b</p>", "a\n\nb\n\n"),
    ("<script>var t='</p>';</script><p>x</p>", "x\n\n"),
    ("<!-- <p>no</p> --><P class='c'>Y &lt;3 &amp;amp;</P>", "Y <3 &amp;\n\n"),
    ("<pre>not p</pre><param>", ""),
    ("<div><p>open<div>after</div>", "open\n\n"),
    ("", ""),
])
def test_tag_text(spark, html, expected):
    df = spark.createDataFrame([(html,)], "html string")
    assert with_tag_text(df, "html", "p", "t").collect()[0].t == expected


def test_tag_text_other_tag(spark):
    df = spark.createDataFrame([("<h1>T</h1><p>x</p><h1>U",)], "html string")
    assert with_tag_text(df, "html", "h1", "t").collect()[0].t == "T\n\nU\n\n"


def test_nested_tag_text(spark):
    html = ('<div class="a">Outer <div>inner &amp; more</div> tail<script>var d="<div>x</div>";</script>'
            "</div><div>second<!-- c --></div><DIV>open")
    want = "Outer inner & more tail\n\ninner & more\n\nsecond\n\nopen\n\n"
    assert element_text(html, "div") == want
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>no divs</p>")], "page_id long, html string")
    got = {r.page_id: r.text for r in with_tag_text(df, "html", "div").collect()}
    assert got == {1: want, 2: None, 3: ""}
    p = "<p>a <b>b</b></p><p>c</p>"
    assert element_text(p, "p") == "a b\n\nc\n\n"


@pytest.mark.parametrize("make", [
    lambda d: "<div>" * d + "x" + "</div>" * d, lambda d: "<b>" * d + "</i>" * d, lambda d: '<p title="' * d, lambda d: '<a "' * d + "'",
    lambda d: "<a<a" * d, lambda d: "<a " * d + '"', lambda d: "<!DOCTYPE[>" * d, lambda d: "<front>" * d + "<year>" * d,
    lambda d: "<div><p>x</p>" * d, lambda d: '<x "\'a' * d, lambda d: "</div>" * d, lambda d: "<p><div>" * d],
    ids=["depth", "unmatched ends", "unclosed quotes", "paired quotes", "names", "far quote", "declarations", "fronts", "paragraphs",
         "mixed quotes", "end tags", "open paragraphs"])
def test_time_grows_with_the_length_only(make):
    """100,000 tags of each kind; twenty times the input takes about twenty times as long."""
    import time

    def took(d):
        markup, began = make(d), time.process_time()
        parse(markup, frozenset(("p", "front", "year")))
        return time.process_time() - began

    took(500)
    small, large = took(5000), took(100_000)
    assert large < 10 and large < 60 * max(small, 0.02)


def test_tags_with_odd_quotes():
    text = lambda m: element_text(m)
    assert text("<p a='x>y' b=\"<\">in</p>") == "in\n\n"
    assert text('<p title="never closed>x</p>') == ""
    assert text('<p>a <b class="x>y</b> z</p>') == 'a <b class="x>y z\n\n'
    assert text("<p>1 < 2 <3</p>") == "1 < 2 <3\n\n"
    assert text('<p>a <i "q"<p>b</p>') == 'a b\n\n'      # one tag, up to the first > outside of quotes


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    from toponymic.operators import article_markup

    rows = [("a" * n,) for n in (5, 50, 1, 1, 40, 0, 3)] + [(None,)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string())], names=["m"])
    parts = list(article_markup._bounded(iter([batch, batch.slice(0, 0)]), 0, 42))
    assert [x for b in parts for x in b.column(0).to_pylist()] == [r[0] for r in rows]
    assert max(sum(len(x or "") for x in b.column(0).to_pylist()) for b in parts if len(b) > 1) <= 42
