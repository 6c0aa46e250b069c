import random

from pyspark.sql import functions as F

from tidemark.operators import filters as FL
from tidemark.operators import terms as TM
from tidemark.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_many_terms_equal_the_loop(spark):
    """Thousands of words, phrases and fragments, pinned in all ways: the same listings as one try for each term, in one automaton or in several."""
    r = random.Random(4)
    listings = X.listings(spark, SF).where("source_id < 6").unionByName(X.listings(spark, SF).limit(5).withColumns({"title": F.lit(None).cast("string"), "location": F.lit("")}))
    words = sorted({w for t in listings.select("title").where("title is not null").distinct().collect() for w in t.title.lower().split()})
    junk = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(1000)]
    pin = lambda w: r.choice(["|{}|", "|{}", "{}|", "{}"]).format(w)
    some = lambda n: [pin(w) for w in r.sample(words, n)] + [pin(w) for w in junk] + [pin(f"{a} {b}") for a, b in zip(words, junk, strict=False)]
    config = {"default": {"titleNone": some(3), "locationNone": ["|china|", "|united states|"]}, "perSource": {"n:1": {"titleAny": some(9)}, "n:2": {"titleAny": some(5), "companyNone": some(1), "remote": "only"}, "n:3": {"titleNone": [], "locationAny": ["peru", "a|"], "remote": "include"}, "n:4": {"titleAny": ["--", "|", "Ä"]}}}
    sources = spark.createDataFrame([(i, "n", str(i)) for i in range(5)], "source_id long, kind string, ident string")
    specs = FL.compiled(FL.resolve(sources, FL.spec_frame(spark, config))).cache()
    want = FL.matching(listings, specs, X.as_of()).select("source_id", "pos", "title", "matches").cache()
    for most in (TM.MOST, 3000):
        got = TM.matching(listings, specs, X.as_of(), most).select("source_id", "pos", "title", "matches")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert 0 < want.where("matches").count() < want.count()
