import pytest
from brute import boilerplate_cut
from pyspark.sql import functions as F

from bidlake.llm.line_dedup import drop_boilerplate_lines, html_lines, url_host

SCHEMA = "doc_id bigint, source string, text string, host string, lines int, boilerplate int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, 2) for r in rows], SCHEMA)


def found(spark, rows, **more):
    df = make(spark, rows)
    out = drop_boilerplate_lines(df, "source", "text", **more)
    assert out.columns == [*df.columns, "line_stats"]
    return {r["doc_id"]: r["text"] for r in out.collect()}


def corpus():
    rows = [(k, "big", f"menu\n  text {k}\n\nmenu \nfooter" if k % 3 else f"text {k}\nmenu")
            for k in range(60)]
    rows += [(100 + k, "small", f"menu\nonly {k}") for k in range(4)]  # fewer than 5 pages
    rows += [(200 + k, None, "menu\nfooter") for k in range(20)]
    rows += [(300, "big", None), (301, "big", ""), (302, "big", "\n \n"), (303, "", "menu"),
             (304, "big", "x " * 50_000 + "\nmenu"), (305, "big", "menu\nmenu\nmenu")]
    return rows


def test_matches_brute_force(spark):
    assert found(spark, corpus()) == boilerplate_cut(corpus())


def test_ratio_is_of_the_site(spark):
    rows = [(k, "a", "half" if k % 2 else f"own {k}") for k in range(20)]
    rows += [(100 + k, "b", "half" if k < 5 else f"own {k}") for k in range(50)]
    got = found(spark, rows)
    assert {got[k] for k in range(1, 20, 2)} == {""}          # 50 % of a
    assert {got[k] for k in range(100, 105)} == {"half"}      # 10 % of b: not exceeded
    assert found(spark, rows, max_ratio=0.05)[100] == ""


def test_empty_and_repeated(spark):
    assert found(spark, []) == {}
    rows = [(1, "a", "x\ny")] * 6
    assert drop_boilerplate_lines(make(spark, rows), "source", "text").count() == 6


def test_stats(spark):
    row = drop_boilerplate_lines(make(spark, corpus()), "source", "text").where(
        "doc_id = 1").first()["line_stats"]
    assert row.asDict() == {"host_pages": 65, "n_lines": 4, "n_dropped": 3}


@pytest.mark.parametrize("url,host", [
    ("https://User@WWW.Example.org:8080/a", "www.example.org"), ("http://a.b?x", "a.b"),
    ("nothing", None), (None, None), ("", None)])
def test_host(spark, url, host):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(url_host(F.col("u"))).first()[0] == host


def test_html(spark):
    html = ("<html><head><style>p{}</style><script>var t='</p>';</script></head><body><p>a <b>b"
            "</b></p><!-- x\n --><div>c</div>\n<br/>d</body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_lines(F.col("h"))).first()[0].strip() == "a b\nc\nd"
