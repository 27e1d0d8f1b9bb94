"""Mixing sources to target weights by a low-discrepancy schedule of slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bucketed_sums, cut_lineage, fresh

# Weights of the sources in code-point order, repeating; the most passes over a source.
WEIGHTS = (5, 2, 1)
PASSES = 3

BLOCK = 256  # words of a block; a slot of the schedule takes one block
STEPS = 1 << 31  # points of the unit interval the schedule distinguishes
GOLDEN = 1327217885  # STEPS / golden ratio, odd: multiples of it run through all points
CELLS = 1024  # cells of the unit interval by which a point finds its source
CHUNK = 4096  # consecutive slots that are ranked together
DIGITS = 3  # hex digits of the hash that deal a source's shuffled documents to 4096 buckets, summed one by one


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): words of every row; null texts have none.  Also the place in the shuffled source."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), digest.alias("place"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, rank, source_size, target): one row per source.

    The targets share the sum of all sizes by weight.  None is above ``passes`` times its source; what is cut off there
    goes to the others by weight.  With sources ordered by ``passes * size / weight`` the capped ones come first, so one
    running sum finds the level at which the sum is right.  Sources are a property of the mixture, one small row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", rank.alias("rank"), weight.cast("long").alias("weight"))
    by_level = Window.orderBy((passes * F.col("source_size")).cast("double") / F.col("weight"), "rank")
    until = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = one.select("*", F.sum("source_size").over(everything).alias("total"),
                        F.coalesce(F.sum(passes * F.col("source_size")).over(until), F.lit(0)).alias("capped"),
                        F.sum("weight").over(after).alias("sharing"))
    # a source is capped when sharing the rest from it on would put it above its cap
    own = (F.col("weight") * (F.col("total") - F.col("capped"))).cast("double") / F.col("sharing")
    free = levels.withColumn("free", own <= passes * F.col("source_size"))
    first = F.first(F.when(F.col("free"), F.struct("capped", "sharing")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, 0))
    share = (F.col("weight") * (F.col("total") - F.col("at.capped"))).cast("double") / F.col("at.sharing")
    return free.withColumn("at", first).select(
        "source", "rank", "source_size",
        F.coalesce(share, (passes * F.col("source_size")).cast("double")).alias("target"))


def schedule(spark: SparkSession, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_rank, nth): the source of every slot and the how-many-th slot of its source it is (from 0).

    Slot t stands at the t-th point of the golden-ratio sequence.  The sources' targets, laid end to end, cut the unit
    interval; the point's piece is the slot's source.  Points are integers below ``STEPS``, so nothing is rounded.  A
    point's cell leads to its piece by an equality join; pieces that end in a cell are told apart by their borders.
    """
    over = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = goals.select("rank", F.sum("target").over(over).alias("upto"), F.sum("target").over(everything).alias("all"))
    end = F.when(F.col("all") > 0, F.floor(STEPS * F.col("upto") / F.col("all"))).otherwise(0).cast("long")
    pieces = ends.select("rank", end.alias("high")).withColumn(
        "low", F.coalesce(F.lag("high").over(Window.orderBy("rank")), F.lit(0))).where("high > low")
    width = STEPS // CELLS
    pieces = pieces.select("*", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    total = goals.agg(F.sum("source_size").alias("s")).first()["s"] or 0  # one number fixes the schedule's length
    point = (F.col("slot") % STEPS * GOLDEN) % STEPS
    slots = spark.range(-(-total // block)).select(F.col("id").alias("slot"), point.alias("point")).withColumn(
        "cell", F.floor(F.col("point") / width))
    placed = slots.join(pieces, "cell").where("point >= low and point < high").select(
        "slot", F.col("rank").alias("source_rank"), F.lit(1).alias("one"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    return bucketed_sums(placed, ["source_rank"], "chunk", ["slot"], "one", "nth").select("slot", "source_rank", "nth")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
        weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """The mixture: (segments, documents).

    ``segments``: (slot, source_rank, row, doc_id, first, n_words), the words that a slot takes of a document, from its
    word ``first`` on.  ``documents``: (row, doc_id, source, size, source_size, target), one per row of ``docs``.

    Each source's documents are shuffled by a hash of their key and laid end to end, pass after pass; every ``block`` words
    are a block.  The n-th slot of a source takes its n-th block.  A source is taken up to the whole part of its target:
    slots beyond are void, and one closing slot per source takes the few words by which the schedule fell short.

    Null texts have no words and take no part, null sources are one source (the last), rows with a null key shuffle as an
    empty key; repeated rows are taken as documents of their own.  An empty table, or one without words, has no slots.
    """
    spark = docs.sparkSession
    sized = cut_lineage(sizes(docs, key, text, source).withColumn("row", F.monotonically_increasing_id()))
    goals = cut_lineage(targets(sized, weights, passes))
    named = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).select(
        "row", "doc_id", sized["source"], "size", "source_size", "target", "rank", "place")
    real = named.where("size > 0").withColumn("bucket", F.conv(F.substring("place", 1, DIGITS), 16, 10).cast("int"))
    laid = cut_lineage(bucketed_sums(
        real.select("rank", "bucket", "place", "doc_id", "size", "row", "source_size", "target"),
        ["rank"], "bucket", ["place", "doc_id", "size", "row"], "size", "start"))

    plan = schedule(spark, goals, block)
    limits = goals.select(F.col("rank").alias("r"), F.floor("target").alias("limit"))
    reached = cut_lineage(plan)
    got = reached.groupBy("source_rank").agg(F.count(F.lit(1)).alias("slots"))
    slots = reached.join(limits, F.col("source_rank") == F.col("r")).select(
        "slot", "source_rank", (F.col("nth") * block).alias("low"),
        F.least((F.col("nth") + 1) * block, F.col("limit")).alias("high")).where("high > low")
    closing = limits.join(got, F.col("r") == F.col("source_rank"), "left").select(
        F.lit(None).cast("long").alias("slot"), F.col("r").alias("source_rank"),
        (F.coalesce("slots", F.lit(0)) * block).alias("low"), F.col("limit").alias("high")).where("high > low")
    # a closing slot is cut at the block borders, so that it meets blocks like any other slot
    cut = lambda df: df.select("slot", "source_rank", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))).alias("b")).select(
        "slot", "source_rank", "b", F.greatest("low", F.col("b") * block).alias("low"),
        F.least("high", (F.col("b") + 1) * block).alias("high"))
    takes = cut(slots).unionByName(cut(closing))

    again = laid.select("row", "doc_id", F.col("rank").alias("source_rank"), "size", "target",
                        F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"), "source_size", "start").withColumn(
        "a", F.col("pass") * F.col("source_size") + F.col("start")).where("a < target")
    blocks = again.select("row", "doc_id", "source_rank", "a", "size", F.explode(F.sequence(
        F.floor(F.col("a") / block), F.floor((F.least(F.col("a") + F.col("size"), F.ceil("target")) - 1) / block))).alias("b"))
    low, high = F.greatest("low", "a"), F.least("high", F.col("a") + F.col("size"))
    segments = takes.join(blocks, ["source_rank", "b"]).select(
        "slot", "source_rank", "row", "doc_id", (low - F.col("a")).alias("first"), (high - low).alias("n_words")).where("n_words > 0")
    return segments, named.select("row", "doc_id", "source", "size", "source_size", "target")


def taken_words(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of ``docs``: key, size, source_size, target and the words the mixture takes of it, repeats counted."""
    segments, rows = mix(docs, key, text, source)
    taken = segments.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken, "row", "left").select(
        F.col("doc_id").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture as documents, columns unchanged: a row of ``docs`` for every pass that takes words of it.

    Whole documents are given out, not their cut parts: a document is repeated as often as a pass over its source
    took it up to its last word, and once more where the last pass took at least half of it.
    """
    same, times, copy = fresh(docs, "same"), fresh(docs, "times"), fresh(docs, "copy")
    got = cut_lineage(taken_words(docs, key, text, source).select(
        F.col(key).alias(same), F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias(times))
        .groupBy(same).agg(F.max(times).alias(times)))
    return docs.join(got, docs[key].eqNullSafe(got[same])).where(F.col(times) > 0).select(
        "*", F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).select(*docs.columns)
