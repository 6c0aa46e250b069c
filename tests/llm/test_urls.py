import duckdb

from tidemark.llm import urls as U


def link(u):
    return f'<html><link rel="canonical" href="{u}"></html>'


ROWS = [
    (0, None, None, "a"),
    (1, "no scheme", "", "a"),
    (2, "https://A.Example.ORG/es/1", None, "a"),
    (3, "https://a.example.org/EN/1?x#y", "", "a"),
    (4, "http://example.org/en/12", "", "a"),
    (5, "http://x.com/fr/1", "", "a"),
    (6, "http://x.com/de/1", "", "a"),
    (7, "http://y.net/p", link("http://x.com/de/1"), "a"),
    (8, "https://www.y.net/p/?q=1", "", "a"),
    (9, "http://z.net/q", '<meta http-equiv="refresh" content="0; url=http://y.net/p.html">', "a"),
    (10, "http://v.net/1", link("http://w.net/1"), "a"),
    (11, "http://w.net/1", link("http://x.com/fr/9") + link("http://zz.net"), "a"),
    (12, "http://x.com/fr/9", link("http://x.com/de/7"), "a"),
    (13, "http://x.com/de/7", "", "a"),
    (14, "com://com/de/x://org/", "", "a"),
    (15, "http://org", "", "a"),
    (16, "http://notorg/", "", "a"),
    (17, "://x.org/a\nb", "", "a"),
    (8, "https://www.y.net/p/?q=1", "", "a"),
]
WANT = {0: (None, "allow"), 2: ("example.org/es/", "block"), 3: ("org/", "allow"), 4: ("example.org/en/1", "block"), 5: ("com/fr/", "allow"), 6: ("com/de/", "block"), 7: (None, "block"), 8: (None, "block"), 9: (None, "block"), 10: (None, "allow"), 11: (None, "allow"), 13: ("com/de/", "block"), 14: ("com/de/", "block"), 15: (None, "allow"), 16: (None, "allow"), 17: ("org/", "allow")}


def test_verdicts_and_oracle(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    got = U.op3_urls(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    for k, v in WANT.items():
        assert by[k] == v, k
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(str, con.execute(U.SQL).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
