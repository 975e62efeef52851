"""Markup in the forms that pages have."""

from snapgate.llm import warc


def test_attributes_in_any_quotes_and_all_named_references(spark):
    html = ("<html class=x lang='de'><title>M&uuml;ller &szlig;</title><a class='k' href='/a?x=1&amp;y'>1</a>"
            "<A HREF=b.html>2</A><a href=/c class=z>3</a><a data-href='no' href=\"/d&eacute;\">4</a><p>&ntilde;&NotEqualTilde;&uuml &bogus;</p>")
    pages = spark.createDataFrame([(1, "http://h.org/e/f", html), (2, "http://h.org/", "<html lang=fr><a href=''>x</a>"),
                                   (3, "http://h.org/", '<html xml:lang="it"><a data-href="no">x</a>')],
                                  "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    about = {r.page_id: r.block.split("\r\n") for r in rows if r.record_type == "metadata"}
    assert [f[9:] for f in about[1] if f.startswith("outlink: ")] == [
        "http://h.org/a?x=1&y", "http://h.org/e/b.html", "http://h.org/c", "http://h.org/dé"]
    assert "language: de" in about[1] and "title: Müller ß" in about[1]
    assert "language: fr" in about[2] and "outlink: http://h.org/" in about[2]
    assert "language: it" in about[3] and {r.link_count for r in rows if r.page_id == 3} == {0}
    assert next(r.block for r in rows if r.page_id == 1 and r.record_type == "conversion").endswith("ñ≂̸&uuml &bogus;")


def test_a_text_is_named_once_and_pieces_are_decoded_in_order(spark):
    made = spark.createDataFrame([("a&amp;b&&lt;&x;&#65;&#x42;&",), ("",), ("plain",), (None,), ("&amp;lt;",), ("amp;x",)], "held string")
    assert [r[0] for r in made.select(warc.decoded(made["held"])).collect()] == [
        "a&b&<&x;AB&", "", "plain", None, "&lt;", "amp;x"]
    # An argument that is named twice is worked out twice: the whole page, for each of its names.
    assert str(warc.decoded(made["held"])).count("held") == 1
