"""Templates of tables whose urls repeat."""

from snapgate.llm import url_templates


def test_slugs_of_repeated_pages_vary(spark):
    urls = [f"http://h.net/user/{a}{b}" for a in "abcd" for b in "efgh"]
    once = url_templates.judge(spark.createDataFrame([(u,) for u in urls], "url string"))
    twice = url_templates.judge(spark.createDataFrame([(u,) for u in urls * 3], "url string"))
    assert {r.template for r in once.collect()} == {r.template for r in twice.collect()} == {"/user/*"}
