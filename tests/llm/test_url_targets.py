import pytest

from tidemark.llm import urls as U

BAD = "http://x.com/de/1"
REFRESH = "<meta http-equiv=refresh content='0; url={}'>"
LINK = "<link rel=canonical href='{}'>"


@pytest.mark.parametrize(
    "url, target, want",
    [
        ("https://a.net/p/q", "/new", "https://a.net/new"),
        ("https://a.net/p/q", "//b.net/z", "https://b.net/z"),
        ("https://a.net/p/q?x=/y", "r", "https://a.net/p/r"),
        ("https://a.net", "r?u=http://c.net", "https://a.net/r"),
        ("https://a.net/p/q/", "../r/./s", "https://a.net/p/r/s"),
        ("https://a.net/p", "?x", "https://a.net/p"),
        ("https://a.net/p", "mailto:x@y.z", None),
        ("https://a.net/p", "HTTP://b.net/?q", "HTTP://b.net/?q"),
        ("none", "/new", None),
    ],
)
def test_resolved(spark, url, target, want):
    df = spark.createDataFrame([(target, url)], "t string, u string")
    assert df.select(U.resolved(df["t"], df["u"])).first()[0] == want


def test_blocks_reach_relative_and_later_targets(spark):
    rows = [
        (1, "http://y.net/p", LINK.format("http://q.net") + LINK.format(BAD)),
        (2, "http://y.net/a/b", REFRESH.format("/p")),
        (3, "http://z.net/1", REFRESH.format("http://q2.net") + REFRESH.format("//y.net/a/b")),
        (4, "http://z.net/2", LINK.format("1")),
        (5, "http://z.net/3", LINK.format("/login?next=" + BAD)),
        (6, BAD, ""),
    ]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}
