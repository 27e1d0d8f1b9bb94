"""Best lists over an inverted index without scoring the whole shelf.

A score is the sum over features of a user's taste times an item's value.  Items with equal vectors are one shape, scored once.  A few
shapes near the user's heaviest seeds give a score that the K-th best item reaches at least.  The most frequent
features, as many as stay below that score all together, open no postings: an item that has nothing but them cannot be in the list.  Of
the other postings, ordered by impact, a user reads only the levels that can still reach the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import scalar_row
from ..session import cut_lineage

# An item has one feature of each of these kinds; it may have many tokens.
EXCLUSIVE = ("category", "brand", "price")
LEVELS = 16  # impact levels of a posting list
TRIAL_SEEDS = 5  # seeds of a user whose surroundings are tried for the first bound
TRIAL_SHAPES = 4  # shapes tried of every combination of a seed's features
HAIR = 2e-6  # scores are compared at six decimals


def _kind(feature: str = "feature") -> Column:
    return F.substring_index(feature, "=", 1)


def _combinations(df: DataFrame, key: str) -> DataFrame:
    """(key, combination): all combinations of the exclusive features of ``key``."""
    wide = df.filter(_kind().isin(*EXCLUSIVE)).groupBy(key).agg(
        *[F.max(F.when(_kind() == k, F.col("feature"))).alias(k) for k in EXCLUSIVE])
    subsets = [[k for n, k in enumerate(EXCLUSIVE) if mask >> n & 1] for mask in range(1, 1 << len(EXCLUSIVE))]
    return wide.select(key, F.explode(F.array(*[F.concat_ws("\n", *s) for s in subsets])).alias("combination"))


def _exact(pairs: DataFrame, postings: DataFrame, taste: DataFrame) -> DataFrame:
    """(user_id, shape, score) of the given pairs."""
    return pairs.join(postings, "shape").join(taste.select("user_id", "feature", "t"), ["user_id", "feature"]).groupBy(
        "user_id", "shape").agg(F.sum(F.col("t") * F.col("v")).alias("score"))


def shapes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shape, feature, v, level, n) of distinct vectors and (item_id, shape) of their members; a shape is named by its smallest item.

    ``level``: impact in steps of 1 / LEVELS, rounded up; ``n``: members.
    """
    signed = vectors.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("feature", "v"))).alias("vector"))
    groups = cut_lineage(signed.groupBy("vector").agg(F.min("item_id").alias("shape"), F.count(F.lit(1)).alias("n")))
    members = cut_lineage(signed.join(groups.select("vector", "shape"), "vector").select("item_id", "shape"))
    postings = groups.select("shape", "n", F.explode("vector").alias("e")).select(
        "shape", F.col("e.feature").alias("feature"), F.col("e.v").alias("v"), F.ceil(F.col("e.v") * LEVELS).cast("int").alias("level"), "n")
    return cut_lineage(postings), members


def first_bounds(seeds: DataFrame, features: DataFrame, postings: DataFrame, taste: DataFrame, hidden: DataFrame, k: int) -> DataFrame:
    """(user_id, bound): a score that ``k`` items the user may see reach, for users for whom the trial finds so many."""
    order = Window.partitionBy("user_id").orderBy(F.desc("w"), "item_id")
    heavy = seeds.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TRIAL_SEEDS).select("user_id", "item_id")
    wanted = heavy.join(_combinations(features.join(heavy.select("item_id").distinct(), "item_id", "left_semi"), "item_id"), "item_id").select(
        "user_id", "combination").distinct()
    each = Window.partitionBy("combination").orderBy("shape")
    few = _combinations(postings, "shape").withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= TRIAL_SHAPES).drop("rank")
    tried = _exact(wanted.join(few, "combination").select("user_id", "shape").distinct(), postings.select("shape", "feature", "v"), taste)
    sizes = postings.select("shape", "n").distinct()
    open_ = tried.join(sizes, "shape").join(hidden, ["user_id", "shape"], "left").withColumn("open", F.col("n") - F.coalesce("hidden", F.lit(0)))
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "shape").rowsBetween(Window.unboundedPreceding, 0)
    return open_.withColumn("seen", F.sum("open").over(best)).filter(F.col("seen") >= k).groupBy("user_id").agg(
        (F.max("score") - HAIR).alias("bound"))


def opened_postings(taste: DataFrame, postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """(user_id, feature, t, least, rest): the posting lists a user opens, from which impact on, and what all closed lists can add at most.

    Of an exclusive kind an item has one feature, so a set of them adds its greatest; tokens add at most the length of
    the taste's token part times the longest token part of an item.
    """
    heads = postings.groupBy("feature").agg(F.max("v").alias("most"), F.count(F.lit(1)).alias("length"))
    token = _kind() == "token"
    norms = postings.filter(token).groupBy("shape").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    longest = scalar_row(norms, top=F.coalesce(F.max("norm"), F.lit(0.0)))["top"]
    mine = taste.join(heads, "feature").join(bounds, "user_id", "left").withColumns(
        {"kind": _kind(), "reach": F.col("t") * F.col("most"), "bound": F.coalesce("bound", F.lit(0.0)), "longest": longest})
    closing = Window.partitionBy("user_id").orderBy(F.desc("length"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("user_id")

    def most(over) -> dict[str, Column]:
        out = {k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("reach"))).over(over), F.lit(0.0)) for k in EXCLUSIVE}
        squares = F.sum(F.when(F.col("kind") == "token", F.col("t") * F.col("t"))).over(over)
        return out | {"token": F.sqrt(F.coalesce(squares, F.lit(0.0))) * F.col("longest")}

    so_far, at_all = most(closing), most(whole)
    total = sum(at_all.values(), F.lit(0.0))
    others = sum((F.when(F.col("kind") == k, F.lit(0.0)).otherwise(at_all[k]) for k in EXCLUSIVE), at_all["token"])
    ruled = mine.withColumns({"below": sum(so_far.values(), F.lit(0.0)), "total": total, "others": others})
    ruled = ruled.withColumn("closed", F.col("below") < F.col("bound"))
    ruled = ruled.withColumn("rest", F.coalesce(F.max(F.when(F.col("closed"), F.col("below"))).over(whole), F.lit(0.0)))
    least = F.when(F.col("kind") == "token", F.lit(0.0)).otherwise(F.greatest((F.col("bound") - F.col("others")) / F.col("t"), F.lit(0.0)))
    return ruled.filter(~F.col("closed")).select("user_id", "feature", "t", "most", least.alias("least"), "rest", "bound")


def best_scores(seeds: DataFrame, taste: DataFrame, features: DataFrame, vectors: DataFrame, bought: DataFrame | None, k: int,
                count_candidates: bool = False) -> DataFrame:
    """(user_id, item_id, score) of every item that can be among the ``k`` best the user may see, and few others.

    ``vectors`` (item_id, feature, v) are the items on the shelf, ``taste`` (user_id, feature, t); all values are positive.
    Exact: what is left out scores less than ``k`` items that the user has not bought.  ``count_candidates`` returns the candidate
    (user, shape) pairs instead, which is what the work grows with.
    """
    postings, members = shapes_of(vectors)
    taste = cut_lineage(taste)
    if bought is None:
        hidden = cut_lineage(taste.select("user_id", F.lit("").alias("shape"), F.lit(0).cast("long").alias("hidden")).limit(0))
    else:
        hidden = cut_lineage(bought.join(members, "item_id").groupBy("user_id", "shape").agg(F.count(F.lit(1)).alias("hidden")))
    bounds = cut_lineage(first_bounds(seeds, features, postings, taste, hidden, k))
    asked = opened_postings(taste, postings, bounds).withColumn("level", F.explode(F.sequence(
        F.greatest(F.floor(F.col("least") * LEVELS).cast("int"), F.lit(0)), F.ceil(F.col("most") * LEVELS).cast("int"))))
    found = asked.join(postings.select("feature", "level", "shape", "v"), ["feature", "level"]).filter(F.col("v") >= F.col("least") - 1e-12).groupBy(
        "user_id", "shape").agg(F.sum(F.col("t") * F.col("v")).alias("partial"), F.first("rest").alias("rest"), F.first("bound").alias("bound"))
    pairs = cut_lineage(found.filter(F.col("partial") + F.col("rest") >= F.col("bound") - 1e-9).select("user_id", "shape", "bound"))
    if count_candidates:
        return pairs.select("user_id", "shape")
    scored = _exact(pairs.select("user_id", "shape"), postings.select("shape", "feature", "v"), taste).join(pairs, ["user_id", "shape"]).filter(
        F.col("score") >= F.col("bound") - 1e-9)
    # of a shape's members, all alike, the first k that the user may see are enough
    reach = scored.join(hidden, ["user_id", "shape"], "left").withColumn("upto", F.lit(k) + F.coalesce("hidden", F.lit(0)))
    deepest = scalar_row(hidden, n=F.coalesce(F.max("hidden"), F.lit(0)))["n"] + k
    inside = Window.partitionBy("shape").orderBy("item_id")
    listed = members.withColumn("position", F.row_number().over(inside)).filter(F.col("position") <= deepest)
    return reach.join(listed, "shape").filter(F.col("position") <= F.col("upto")).select("user_id", "item_id", "score")
