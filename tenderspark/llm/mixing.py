"""Mixing sources to target weights by hash-threshold histograms, with built-in functions only.

Sources in order of code points (null last) weigh WEIGHTS in turn and share BUDGET of all words; a target stops at CAP times
its source's words, and the excess is shared again by weight until none is above.  That fixed point is the water level: the
sources with the least cap for their weight are full, the others get level * weight.

A source with target t and s words takes every document floor(t / s) times, and the rest of t from documents in order of a
hash of the id, up to a threshold.  The threshold is found without sorting documents: words are summed by source and hash
bucket, running sums over at most 2**STEP buckets a source find the bucket in which the budget ends, and only that bucket is
cut finer, until it holds one hash.  The document on the boundary is taken if that comes nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, slim, stored

WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2
#: Bits of the hash, and bits that each pass resolves.
HASH, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"
#: A threshold that all hashes are below.
ALL = 1 << HASH


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; rows without an id share 0."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, HASH // 4), 16, 10).cast("long"), F.lit(0).cast("long"))


def _keyed(df: DataFrame) -> DataFrame:
    """A null source is a source of its own; joins go by these two columns."""
    return df.withColumns({"k": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})


def targets(sizes: DataFrame) -> DataFrame:
    """(k, none, source_size, target) of each source.  One row a source from here on, so the windows see sources only."""
    by = sizes.groupBy("k", "none").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("none", "k")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    by = by.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "none", "k")
    by = by.withColumn("full", F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.lit(BUDGET) * F.col("total") - F.lit(CAP) * F.col("full")) / F.col("open")
    by = by.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") < F.lit(CAP) * F.col("source_size"))
    by = by.withColumn("order", F.row_number().over(fill))
    by = by.withColumn("water", F.min_by("level", F.when(F.col("below"), F.col("order"))).over(Window.partitionBy()))
    top = (F.lit(CAP) * F.col("source_size")).cast("double")
    return by.select("k", "none", "source_size", F.least(top, F.coalesce(F.col("water") * F.col("weight"), top)).alias("target"))


def thresholds(sizes: DataFrame) -> DataFrame:
    """`sizes` (k, none, h, size, kept in a table) -> (k, none, source_size, target, times, theta, edge): a document is taken
    `times` times, and once more if its hash is below theta, or at it and `edge` says so."""
    goal = targets(sizes)
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(0).cast("int")
    goal = stored(goal.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size")), "sources")
    done = goal.where("left <= 0").select("k", "none", F.lit(0).cast("long").alias("theta"), F.lit(False).alias("edge"))
    state = goal.where("left > 0").select("k", "none", "left", F.lit(0).cast("double").alias("spent"), F.lit(0).cast("long").alias("prefix"))
    shift = HASH
    while True:
        # documents in the bucket where the budget ends, by source and next STEP bits
        inside = sizes.withColumn("prefix", F.shiftright("h", shift)).join(state, ["k", "none", "prefix"])
        shift -= STEP
        bucket = inside.groupBy("k", "none", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"), F.first("left").alias("left"), F.first("spent").alias("spent"))
        run = Window.partitionBy("k", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bucket = bucket.withColumn("at", F.col("spent") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        ends = stored(bucket.where("at <= left AND left < at + size"), "boundary")
        met = ends.where("first = last").select("k", "none", F.col("first").alias("theta"), (F.col("at") + F.col("size") / 2 <= F.col("left")).alias("edge"))
        done = done.unionByName(met)
        state = ends.where("first < last").select("k", "none", "left", F.col("at").alias("spent"), F.col("bucket").alias("prefix"))
        if not shift or state.isEmpty():
            break
    every = goal.join(done, ["k", "none"], "left")
    return every.select("k", "none", "source_size", "target", "times", F.coalesce("theta", F.lit(ALL)).alias("theta"), F.coalesce("edge", F.lit(False)).alias("edge"))


def _times() -> Column:
    more = (F.col("h") < F.col("theta")) | ((F.col("h") == F.col("theta")) & F.col("edge"))
    return F.col("times") + more.cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Null and empty texts have size 0 and take nothing; rows that repeat an id are taken or left together; rows without an id
    share a hash.  A source whose words are all taken CAP times stands at its cap.  No rows in, no rows out.
    """
    sizes = _keyed(slim(docs, "doc_id", "text", "source").select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")))
    sizes = stored(sizes.drop("source"), "sizes")
    out = sizes.join(thresholds(sizes), ["k", "none"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def stage(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken.  Only the sources' thresholds meet the texts.

    Null and empty texts have no words and are taken as their hash falls; repeated rows are taken together; a null source is a
    source; no rows in, no rows out."""
    k, none, times, theta, edge, copy = free(docs.columns, "k", "none", "times", "theta", "edge", "copy")
    lean = _keyed(slim(docs, "doc_id", "text", "source").select("source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h"))).drop("source")
    marks = thresholds(stored(lean, "sizes")).select(*[F.col(c).alias(x) for c, x in zip(("k", "none", "times", "theta", "edge"), (k, none, times, theta, edge), strict=True)])
    h = hash_of(F.col("doc_id"))
    found = docs.join(marks, (F.coalesce("source", F.lit("")) == F.col(k)) & (F.col("source").isNull() == F.col(none)))
    more = (h < F.col(theta)) | ((h == F.col(theta)) & F.col(edge))
    return found.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times) + more.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
