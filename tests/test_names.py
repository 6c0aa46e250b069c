from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import names as N
from tidemark.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_folding_in_the_jvm_is_unicodedatas(spark):
    """Every code point, alone and between letters; the helper's class is small, and holds what must be."""
    for last in ("NFKC", None):
        every = spark.range(1, 0x110000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
        both = every.unionByName(every.select(F.concat(F.lit("Aé"), "c", F.lit("B")).alias("c"))).withColumn("helped", T.needs_helper(F.col("c"), last))
        plain = both.where("not helped").withColumn("f", T.fold_mapped(F.col("c"), last))
        wrong = plain.where(~F.col("f").eqNullSafe(T.fold(F.concat("c", F.lit("à")), last).substr(F.lit(1), F.length("f"))) | (F.length(T.fold(F.concat("c", F.lit("à")), last)) != F.length("f") + 1))
        assert wrong.count() == 0
        n = both.where("helped").count()
        assert 0 < n < 2 * (6_000 if last else 18_000)
    words = [("Straße", False), ("ﬁnal", True), ("ΟΔΟΣ", True), ("한국", False), ("Čeština", False), ("plain", False), (None, False), ("½", True)]
    got = spark.createDataFrame([(w,) for w, _ in words], "w string").select("w", T.needs_helper(F.col("w")).alias("h")).collect()
    assert [(r.w, r.h) for r in got] == words


def test_dictionary_keys_are_the_keys(spark):
    listings = X.listings(spark, SF).unionByName(X.listings(spark, SF).limit(20).withColumns({"title": F.lit("Ingénieur ﬁlm (m/w/d)"), "company": F.lit(None).cast("string"), "location": F.lit("ΟΔΟΣ")}))
    some = N.normalised(N.strings(listings.where("okey % 2 = 0"))).cache()
    rest = N.normalised(N.missing(listings, some)).cache()
    assert some.count() and rest.count() and some.join(rest, ["kind", "raw"]).where(some.remote.eqNullSafe(rest.remote)).count() == 0
    got = N.keyed(listings, some.unionByName(rest)).select("source_id", "pos", "title", "key", "key_full")
    want = T.with_keys(listings).select("source_id", "pos", "title", "key", "key_full")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert N.missing(listings, some.unionByName(rest)).count() == 0


def test_plain_strings_never_leave_the_jvm(spark):
    wanted = spark.createDataFrame([("title", "Plain Clerk", None), ("company", "Café GmbH", None), ("location", "Ålesund", True)], N.ENTRIES.replace(", value string", ""))
    plain = wanted.where(~T.needs_helper(F.col("raw"))).select(T.normalise_title(F.col("raw"), by=T.fold_mapped))
    assert "Python" not in plain._jdf.queryExecution().executedPlan().toString() and plain.count() == 3
