import duckdb

from tidemark.llm import licenses as C

MIT = C.KNOWN[11][1]
ROWS = [
    (0, None, "MIT"),
    (1, "", "x"),
    (2, MIT, "x"),
    (3, "\n COPYRIGHT 2020 someone else\n\n" + MIT.split("\n\n", 2)[0].lower().replace("license", "LICENCE") + "\n(c) me\n" + MIT.split("\n\n", 2)[2].replace(",", " ; "), "x"),
    (4, "text\nReleased under the MIT Licence\nmore\n*** Licensed under CC BY-NC 4.0 ***\nReleased under the MIT License.", "x"),
    (5, "Copyright only", "x"),
    (6, "ünï — text\nnothing here", "x"),
    (7, "w " * 50000, "x"),
    (8, "Released under the MIT License." + " " * 3000 + "!" * 3000, "x"),
    (None, "All rights reserved.", "x"),
]


def test_scan(spark):
    docs = spark.createDataFrame(ROWS + [ROWS[4]], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in C.scan(docs).collect()}
    assert C.scan(docs).count() == len(ROWS) + 1
    assert got[0].text_digest is None and got[1].license is None and got[5].text_digest is None
    assert got[2].license == got[3].license == "MIT" and got[2].text_digest == got[3].text_digest
    assert got[4].notices == ["CC-BY-NC-4.0", "MIT"] and got[4].n_notices == 3 and got[4].license is None
    assert got[6].notices == [] and got[7].n_notices == 0 and got[8].notices == ["MIT"]
    assert got[None].license == "Proprietary" and got[None].notices == ["Proprietary"]
    assert C.scan(docs.limit(0)).count() == 0


def test_oracle(spark, tmp_path):
    spark.createDataFrame(ROWS[:9], "doc_id long, text string, license string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(C.SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in C.op8_licenses(spark, str(tmp_path)).collect()), key=str) == want
