"""Line dedup by a suffix array over line ids, built by distributed prefix doubling, with built-in functions only.

Documents stand in order of (doc_id, hash of the text), null ids last; their lines that are not blank make up the sequence,
and a line's place in it is a number.  A suffix is what follows from a place to its document's end.

Doubling.  Level k ranks the suffixes by their first 2**k lines.  The rank of 2h lines comes from the rank of h lines and the
rank of the h lines that follow; a rank is the place of its first copy, so one aggregation, combined before the shuffle, ranks
all suffixes and finds those that are alone in their rank.  These drop out, and doubling goes on until none is left: then the
order of ranks is settled for all suffixes, and those that share a rank at a level are an interval with a common prefix.

Intervals.  The intervals are walked down from the deepest level to single lines.  A suffix stands in the deepest interval
known to hold an earlier place; level k deals the interval into those that agree on 2**k lines more.  Each part becomes an
interval of its own, and of it only the first place is left behind: any other that a suffix outside could meet agrees with it
no longer.  So no group is ever gathered, and in the end each suffix knows the longest common prefix it has with any earlier
place: its repeated run.  Runs that the one before covers are not maximal; of the maximal ones those of MIN_WORDS words or
more are copies, and their lines go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free, slim, stored

MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a place that count lines within a range of documents.
RANGE = 40
DOC = ("n", "id", "th")


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.isNull().alias("n"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("th")]


def _parts(text: Column) -> Column:
    return F.split(text, "\n")


def lines(docs: DataFrame) -> DataFrame:
    """(n, id, th, seq, words, l1, l2): each line that is not blank; seq counts those; l1 and l2 are its id of 128 bits."""
    rows = slim(docs, "doc_id", "text").where(F.col("text").isNotNull())
    out = rows.select(*_key(F.col("doc_id"), F.col("text")), F.posexplode(F.filter(_parts(F.col("text")), lambda x: x.rlike(WORD))).alias("seq", "line"))
    line = F.col("line")
    return out.select(*DOC, "seq", F.regexp_count(line, F.lit(WORD)).alias("words"), F.xxhash64(line).alias("l1"), F.xxhash64(F.lit("second"), line).alias("l2"))


def _placed(found: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines with their place, the place where the repeated lines around them end (`stop`), and how many lines from
    here on have `min_words` words (`need`, null if the document ends before).  Rows that repeat id and text count once."""
    most = found.count()
    copies = stored(found.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "copies", most // 2)
    again = stored(found.join(copies, ["l1", "l2"]).groupBy(*DOC, "seq").agg(*[F.first(c).alias(c) for c in ("l1", "l2", "words")]), "again", most)
    most = again.count()
    # ranges of documents in order; within one, lines are counted on, with a gap after each document
    sizes = again.groupBy(*DOC).agg((F.max("seq") + 2).alias("size")).repartitionByRange(*DOC).withColumn("range", F.spark_partition_id().cast("long"))
    before = Window.partitionBy("range").orderBy(*DOC).rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sizes.select(*DOC, (F.shiftleft("range", RANGE) + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("base")), "base", most)
    rows = again.join(base, list(DOC)).select(*DOC, "seq", "words", "l1", "l2", (F.col("base") + F.col("seq")).alias("place"))
    doc = Window.partitionBy(*DOC).orderBy("place")
    rows = rows.withColumn("sum", F.coalesce(F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = F.coalesce(F.lead("place").over(doc) != F.col("place") + 1, F.lit(True))
    rows = rows.withColumn("stop", F.when(ends, F.col("place") + 1))
    rows = rows.withColumn("stop", F.min("stop").over(doc.rowsBetween(0, Window.unboundedFollowing)))
    words = Window.partitionBy(*DOC).orderBy("sum").rangeBetween(0, min_words - 1)
    rows = rows.withColumn("need", F.when(F.sum("words").over(words) >= min_words, F.count(F.lit(1)).over(words))).drop("sum", "words")
    rows = stored(rows, "placed", most)
    dropped(copies, again, base)
    return rows


def _anew(*names: str) -> list[Column]:
    """The same values as new columns: both sides of a join by them are dealt anew, so that a hot key can be split."""
    return [F.col(c).bitwiseXOR(F.lit(0)).alias(f"{c}_") for c in names]


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """`right` is an aggregate by `keys`."""
    others = [c for c in right.columns if c not in keys]
    again = right.select(*_anew(*keys), *others)
    on = [F.col(k) == F.col(f"{k}_") for k in keys]
    return left.join(again, on, how).drop(*[f"{k}_" for k in keys])


def _ranked(rows: DataFrame, by: list[str], name: str, most: int) -> DataFrame:
    """(place, stop, rank) of the rows that share the keys `by` with another; rank is the place of the first copy."""
    first = rows.groupBy(*by).agg(F.min("place").alias("rank"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return stored(_join(rows, first, by, "inner").select("place", "stop", "rank"), name, most)


def ranks(placed: DataFrame) -> list[DataFrame]:
    """Level k: (place, stop, rank) of each suffix whose first 2**k lines stand at another place too; the last level is empty."""
    levels = [_ranked(placed.select("place", "stop", "l1", "l2"), ["l1", "l2"], "rank0", placed.count())]
    h = 1
    while most := levels[-1].count():
        last = levels[-1]
        follows = last.select((F.col("place") - h).alias("place"), F.col("rank").alias("b"))
        pairs = last.where(F.col("place") + 2 * h <= F.col("stop")).withColumnRenamed("rank", "a").join(follows, "place")
        levels.append(_ranked(pairs, ["a", "b"], f"rank{len(levels)}", most))
        h *= 2
    return levels


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """(place, common): lines that the suffix has in common with an earlier place, for all that have one in common."""
    done, state, held = [], None, 0
    for k in range(len(levels) - 2, -1, -1):
        h, level = 1 << k, levels[k]
        entering = level.join(levels[k + 1].where("rank < place").select("place"), "place", "left_anti") if k < len(levels) - 2 else level
        now = entering.select("place", "stop", F.col("rank").alias("first"), F.lit(h).cast("long").alias("common"))
        if state is not None:
            at = level.select(F.col("place").alias("at"), "rank")
            asked = state.withColumn("at", F.col("place") + F.col("common")).join(at, "at", "left").drop("at")
            part = asked.where("rank IS NOT NULL").groupBy("first", "common", "rank").agg(F.min("place").alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            deeper = F.struct(F.col("own").alias("first"), (F.col("common") + h).alias("common"))
            here = F.struct("first", "common")
            stands = F.when(F.col("own").isNull(), F.array(here)).when(F.col("own") == F.col("place"), F.array(deeper, here)).otherwise(F.array(deeper))
            moved = _join(asked, part, ["first", "common", "rank"], "left").select("place", "stop", F.explode(stands).alias("s")).select("place", "stop", "s.first", "s.common")
            now = moved.unionByName(now)
        # a suffix that reaches the end of the repeated lines has its answer; a first place there can meet no one any more
        now = stored(now, "intervals", 2 * held + level.count())
        held = now.count()
        over = (F.col("place") + F.col("common") == F.col("stop")) if k else F.lit(True)
        done.append(now.where(over & (F.col("first") < F.col("place"))).select("place", "common"))
        state = now.where(~over)
    if not done:
        return levels[0].select("place", F.lit(0).cast("long").alias("common"))
    return reduce(DataFrame.unionByName, done)


def runs(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`lines` in a table -> (n, id, th, seq, size): the maximal runs of `min_words` words or more that also stand at an
    earlier place, each as its first line's number among those that are not blank and its number of lines."""
    placed = _placed(found, min_words)
    levels = ranks(placed)
    common = prefixes(levels)
    doc = Window.partitionBy(*DOC).orderBy("place")
    rows = placed.select(*DOC, "seq", "place", "need").join(common, "place")
    covered = (F.lag("place").over(doc) == F.col("place") - 1) & (F.lag("common").over(doc) > F.col("common"))
    maximal = rows.withColumn("covered", F.coalesce(covered, F.lit(False))).where("NOT covered AND common >= need")
    return maximal.select(*DOC, "seq", F.col("common").cast("int").alias("size"))


def spans(found: DataFrame) -> DataFrame:
    """`runs` -> (n, id, th, spans): of each document the stretches of lines that runs cover, as {a, b}, b after the last."""
    doc = Window.partitionBy(*DOC).orderBy("seq")
    ends = found.withColumn("end", F.col("seq") + F.col("size"))
    reach = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce(F.col("seq") > F.col("reach"), F.lit(True)).cast("int")).over(doc)
    whole = ends.withColumn("reach", reach).withColumn("island", island).groupBy(*DOC, "island").agg(F.min("seq").alias("a"), F.max("end").alias("b"))
    return whole.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often a lambda in it asks for it."""
    return F.transform(F.array(value), body)[0]


def _left(text: Column, cut: Column) -> Column:
    """The text without the lines that `cut` covers, in time proportional to its length."""

    def without(parts: Column) -> Column:
        filled = F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
        drop = _let(filled, lambda at: F.flatten(F.transform(cut, lambda s: F.slice(at, s["a"] + 1, s["b"] - s["a"]))))
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop), lambda k: F.get(parts, k))
        return _let(kept, lambda own: F.when(F.exists(own, lambda x: x.rlike(WORD)), F.array_join(own, "\n")).otherwise(F.lit("")))

    return _let(_parts(text), without)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of `docs` with the text left, and under `names` (which must be free) the numbers of lines before and of
    lines deleted.

    A null text stays null (0 lines); an empty one is one blank line and stays; blank lines are never deleted, unless every
    other line of their text is.  Rows that repeat id and text are one document and come out alike.  No rows in, no rows out.
    """
    found = stored(lines(docs), "lines")
    gone = stored(spans(runs(found, min_words)), "spans", found.count())
    helpers = free([*docs.columns, *names], "n", "id", "th", "spans")
    gone = gone.select(*[F.col(c).alias(x) for c, x in zip((*DOC, "spans"), helpers, strict=True)])
    n, i, th, cut = helpers
    here = _key(F.col("doc_id"), F.col("text"))
    out = docs.join(gone, (here[0] == F.col(n)) & (here[1] == F.col(i)) & (here[2] == F.col(th)), "left")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(_left(F.col("text"), F.col(cut)))
    cols = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda t, s: t + s["b"] - s["a"]), F.lit(0))
    return out.select(*cols, F.coalesce(F.size(_parts(F.col("text"))), F.lit(0)).alias(names[0]), removed.alias(names[1]))


def stage(docs: DataFrame) -> DataFrame:
    """Documents without the later copies of runs; those that lose all their lines go.

    A null or empty text stays as it is; repeated rows come out alike; no rows in, none out.  `n_chars`, if there, follows
    the text where lines were deleted."""
    before, gone = free(docs.columns, "n_lines", "n_removed")
    out = dedup(docs, names=(before, gone)).where((F.col(gone) == 0) | (F.col("text") != ""))
    chars = F.when(F.col(gone) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
