"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.landing import shared_dir

#: ASCII white space as the contracts state it: space and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    df.sparkSession._jvm.System.gc()  # see ``freed``


def freed(spark: SparkSession) -> None:
    """Let the shuffle files of plans that nothing refers to go now.

    Spark deletes them when the driver's garbage collector finds the plans unused. Steps with large exchanges would otherwise fill the
    executors' disks first. References from Python go in one collection, the plans in the next, and files a moment later.
    """
    gc.collect()
    for _ in range(3):
        spark._jvm.System.gc()
        time.sleep(0.3)


#: Names of working columns start so.
WORKING = "_w_"


def _moved(name: str) -> str:
    return f"__in{name}" if name.startswith((WORKING, "__in")) else name


def aside(df: DataFrame) -> DataFrame:
    """``df`` with the caller's columns that look like working columns renamed, so that no name clashes. ``restored`` undoes it."""
    return df.select(*[F.col(f"`{c}`").alias(_moved(c)) for c in df.columns])


def restored(out: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df``, in order, from what was made of ``aside(df)``."""
    return out.select(*[F.col(f"`{_moved(c)}`").alias(c) for c in df.columns])


def ascii_lower(col: Column) -> Column:
    """Lower-case A to Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Words between runs of ASCII white space; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE), lambda w: w != "")


def row_key() -> Column:
    """Tells rows of documents apart but for rows with equal doc_id and text."""
    return F.xxhash64("doc_id", "text")


def one_of_each(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class, with all columns. ``classes``: (doc_id, key, part) for every row of ``documents``.

    The smallest doc_id of a class stays (null only if it has none but null), of equal ones the smallest text hash, of
    equal rows an arbitrary one. Rows are told by id and text, so texts that share a doc_id aren't lost.
    """
    none = F.col("doc_id").isNull().alias("none")
    first = classes.groupBy("part").agg(F.min(F.struct(none, "doc_id", "key")).alias("f")).select(F.col("f.doc_id").alias("_w_doc"), F.col("f.key").alias("_w_key"))
    kept = aside(documents).withColumn("_w_row", row_key()).join(first, F.col("doc_id").eqNullSafe(F.col("_w_doc")) & (F.col("_w_row") == F.col("_w_key")), "left_semi")
    if not classes.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_w_row"])
    return restored(kept, documents)


def link_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)``, component = smallest node.

    Alternating large-star and small-star rounds. Every round is a join and an aggregate
    over the links that are left, written to the shared folder; nothing is gathered on
    the driver but a count and a checksum that tell when a round changed nothing. Nodes without links don't
    appear. Null ends and self links are ignored.
    """
    links = stored(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col(src) != F.col(dst)))
        .distinct(),
        "links",
    )
    before = _mark(links)
    for _ in range(max_rounds):
        if before == (0, None):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = stored(small, "links")
        dropped(links)
        links, now = after, _mark(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
