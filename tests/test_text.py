from pyspark.sql import functions as F

from weft.functions import html_text, porter, text, urls

PAGE = """<!DOCTYPE html><html><head><title>Home</title><style>h1 { color: red; }</style></head>
<body><div class="c"><h1>Welcome to the simple links</h1>
<p>Look at <a href="one/index.html">Some stuff</a>.</p>
<p>Look at <a HREF='two/index.html'>More &amp; stuff</a>.</p></div>
<div><p>© 2023. All rights reserved.</p></div><script>var x = "</p>";</script></body></html>"""


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_html_to_text(spark):
    col = text.html_to_text(F.col("h"))
    assert one(spark, col, h="a<script>x<b></script>b&nbsp;c &AMP; d<STYLE>s</style> ") == "a b c & d"
    assert one(spark, col, h="") == ""
    assert one(spark, col, h=" a \n b﻿") == "a b"
    assert one(spark, col, h=None) is None


def test_document_text():
    assert html_text.document_text(PAGE).split("\n\n") == [
        "WELCOME TO THE SIMPLE LINKS",
        "Look at Some stuff [one/index.html].",
        "Look at More & stuff [two/index.html].",
        "© 2023. All rights reserved.",
    ]
    assert html_text.document_text(None) is None and html_text.document_text("") == ""


def test_terms_and_stems(spark):
    col = text.terms(F.col("t"))
    assert one(spark, col, t="The Links, and 2 RUNNING boxes passed! its as bed Ring") == ["link", "runn", "box", "pass", "bed", "ring"]
    assert one(spark, col, t=None) == one(spark, col, t="  12 ") == one(spark, col, t="the of") == []
    assert text.terms_of("The Links, and 2 RUNNING boxes passed! its as bed Ring") == ["link", "runn", "box", "pass", "bed", "ring"]
    assert one(spark, text.terms(F.col("t"), ["links"]), t="the links") == ["the"]


def test_local_tokens_drop_letters_beyond_ascii(spark):
    assert one(spark, text.local_tokens(F.col("t"), []), t="Étage KİT") == ["tage", "k", "t"]


def test_ngrams(spark):
    words = F.split("t", " ")
    assert one(spark, text.ngrams(words), t="a b c") == ["a", "a b", "a b c", "b", "b c", "c"]
    assert one(spark, text.ngrams(words), t="a") == ["a"]
    assert one(spark, text.ngrams(words, "\t"), t="a b") == ["a", "a\tb", "b"]
    for t in ("a b c d e", "a", "a b", ""):
        assert sorted(one(spark, text.ngrams(words), t=t)) == sorted(one(spark, text.ngram_bag(words), t=t))
    assert one(spark, text.ngram_bag(words, [2]), t="a b c") == ["a b", "b c"]


def test_porter():
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop filing file happy happi sky sky relational relat simple simpl rights right links link level level electrical electr adoption adopt controll control probate probat"
    words = pairs.split()
    assert [porter.porter(w) for w in words[::2]] == words[1::2]


def test_links(spark):
    assert one(spark, urls.hrefs(F.col("h")), h=PAGE) == ["one/index.html", "two/index.html"]
    assert one(spark, urls.hrefs(F.col("h")), h="<a name=x>no</a><a href=bare>") == [] == one(spark, urls.hrefs(F.col("h")), h=None)
    df = spark.createDataFrame([("https://h.org/a/index.html", PAGE + '<a href="one/index.html">'), ("https://h.org/a", '<a href="mailto:x@y"><a href="/p.PDF"><a href="#top">')], "u string, h string")
    rows = df.select(urls.local_links(F.col("u"), F.col("h")), urls.page_links(F.col("u"), F.col("h"))).collect()
    assert rows[0][0] == ["https://h.org/a/one/index.html", "https://h.org/a/two/index.html", "https://h.org/a/one/index.html"]
    assert rows[0][1] == ["https://h.org/a/index.html", "https://h.org/a/one/index.html", "https://h.org/a/two/index.html"]
    assert rows[1][1] == ["https://h.org/a", "https://h.org/a#top"]


def test_links_of_the_parsed_document(spark):
    html = """<!-- <a href="no"> --><a href=bare>x</a><A class="c" HREF='q?a=1&amp;b=2'>y</A><script>'<a href="no">'</script><a name="n">z</a><a href="bare" href="no">"""
    assert html_text.anchors(html) == ["bare", "q?a=1&b=2", "bare"] and html_text.anchors(None) == [] == html_text.anchors("")
    base = "https://h.org/a/"
    assert one(spark, urls.local_links(F.col("u"), F.col("h")), u=base + "index.html", h=html) == [base + "bare", base + "q?a=1&b=2", base + "bare"]


def test_lists_of_a_document():
    html = "<p>before</p><ul><li>one<li>two <b>bold</b><br>more<ol><li>x</li><li><p>y</p><p>z</p></li></ol></li></ul><p>after</p><li>stray</li>"
    assert html_text.document_text(html) == "before\n\n * one\n * two bold\n   more\n    1. x\n    2. y\n\n       z\n\nafter\n\nstray"


def test_lines_tables_rules_and_images():
    text = html_text.document_text
    assert text("<p>" + "word " * 40 + "</p>") == "\n".join([" ".join(["word"] * 16)] * 2 + [" ".join(["word"] * 8)])
    assert text("<ul><li>" + "abc " * 30 + "</li></ul>").split("\n") == [" * " + " ".join(["abc"] * 19), "   " + " ".join(["abc"] * 11)]
    assert text("a " + "x" * 100 + " b") == "a\n" + "x" * 100 + "\nb" and text("a " * 60, None) == ("a " * 60).strip()
    assert text("one<table><tr><td>a</td> <td>b</td></tr>\n<tr><td>c</td><td>d</td></tr></table>two") == "one\n\na b cd\n\ntwo"
    assert text("a<hr>b", 5) == "a\n\n-----\n\nb" and text('<img alt="A cat" src="c.png"> <img src="d.png"><img alt="e">') == "A cat [c.png] [d.png]e"
    assert text("<pre>x  y\n  z</pre>w") == "x  y\n  z\n\nw"


def test_normal_url():
    assert urls.normal_url("HTTP://Ex.ORG:80", "http://b/") == "http://ex.org/"
    assert urls.normal_url("/für x?q=é#f", "https://b.org/a") == "https://b.org/f%C3%BCr%20x?q=%C3%A9#f"
    assert urls.normal_url("http://[bad", "http://b/") is None


def test_url_predicates(spark):
    rows = [
        ("https://a.org/x", True, False), ("ftp://a.org/x", False, False), ("http://a.org/i.PNG", False, False), ("http://a.org/i?x=.png", True, False), (None, False, False), ("nonsense", False, False),
        ("http://s/catalogue/b_12/index.html", True, True), ("http://s/catalogue/category/b_12/index.html", True, False), ("http://m.org/books/1342.txt", True, True), ("http://m.org/books/books.txt", True, False), ("http://m.org/books/readme.txt", True, False),
    ]
    df = spark.createDataFrame(rows, "u string, c boolean, i boolean")
    u = F.col("u")
    got = df.select("u", "c", "i", urls.should_crawl(u).alias("gc"), urls.is_indexable(u, urls.ebook_file(u, "m.org", "/books/")).alias("gi")).collect()
    assert [(r.u, r.gc, r.gi) for r in got] == rows
    assert df.where(urls.text_file(u, "m.org", "/books/")).count() == 3
