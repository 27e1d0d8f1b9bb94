"""Top-K recommendations for all users at once: popular, item-based, user-based, content, blended.

Scores live in long tables (user_id, item_id, score); nothing is a matrix on the driver.  Neighbour scores are products of sparse
blocks, content scores are made in cells of users and items; the whole tables of scores exist only for who asks for them.
Where the list is global, each user needs only its head, and how far down the head reaches follows from what that
user must not see.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import products
from ..functions.quantiles import bin_index, quantile_edges
from ..functions.scalar import by_maximum, min_max, scalar_row, time_decay, weight_of
from ..functions.sequence import even_buckets, running_total
from ..schemas import BEHAVIOR_TYPES
from ..session import cut_lineage
from ..settings import RecommendSettings
from .blending import blended, content_best, content_table
from .revenue import paid_lines

REASONS = {
    "popular": "popular across the shop", "itemcf": "often visited together with items you used",
    "usercf": "liked by users with similar taste", "content": "similar in category, brand, price or name",
    "hybrid": "blend of item, user, popularity and content scores",
}
EPSILON = 1e-9


# ---- shared parts ----------------------------------------------------------------------------
def reference_day(behaviors: DataFrame, cfg: RecommendSettings) -> Column:
    """The configured day or the last one with data, as a literal: decay and filters fold it in."""
    if cfg.as_of:
        return F.lit(cfg.as_of).cast("date")
    return F.lit(behaviors.agg(F.max("event_date")).first()[0]).cast("date")


def on_shelf(items: DataFrame, cfg: RecommendSettings) -> DataFrame:
    kept = items.filter(F.col("status") == 1) if cfg.drop_off_shelf else items
    return kept.select("item_id").distinct()


def purchased(orders: DataFrame, order_items: DataFrame, until=None) -> DataFrame:
    """Distinct (user, item) of paid orders, up to and including the day ``until``."""
    if until is not None:
        day = until if isinstance(until, Column) else F.lit(until).cast("date")
        orders = orders.filter(F.to_date("order_time") <= day)
    return paid_lines(order_items, orders).select("user_id", "item_id").distinct()


def candidates(scored: DataFrame, shelf: DataFrame, bought: DataFrame | None) -> DataFrame:
    """Keep items on the shelf that the user has not bought."""
    scored = scored.join(shelf, "item_id", "left_semi")
    return scored if bought is None else scored.join(bought, ["user_id", "item_id"], "left_anti")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per user; scores are compared at six decimals, lower ids first on ties."""
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 6)), "item_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("user_id", "item_id", "rank", F.round("score", 4).alias("score"))


def positions(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``position`` 1.. of items by score (per ``by``) without sorting them in one task; scores may cluster as they like."""
    numbered = scores.withColumns({"key": F.round("score", 6), "one": F.lit(1)})
    order = [F.desc("key"), F.col("item_id")]
    return running_total(even_buckets(numbered, [*by, *order]), "bucket", order, ["one"], by).select(
        *by, "item_id", "score", F.col("cum_one").alias("position"))


def global_heads(scores: DataFrame, users: DataFrame, excluded: DataFrame | None, k: int, by: str | None = None,
                 names: tuple[str, ...] = ()) -> DataFrame:
    """First ``k`` items of a global list per user, skipping the user's excluded items.

    A user with x excluded items on the list finds ``k`` others within the first k + x places, so
    the rows made here grow with users and exclusions only.  The numbered list is read several times
    and is written once.  With ``by`` there is one list for each of its ``names``, all handled in one go.
    """
    lists = (by,) if by else ()
    ranked = cut_lineage(positions(scores, lists))
    if by:
        users = users.withColumn(by, F.explode(F.array(*[F.lit(n) for n in names])))
    if excluded is None:
        reach = users.select(*lists, "user_id", F.lit(k).cast("long").alias("reach"))
        spots = reach.select(*lists, "user_id", F.explode(F.sequence(F.lit(1).cast("long"), "reach")).alias("position"))
        return spots.join(ranked.filter(F.col("position") <= k), [*lists, "position"]).select(
            *lists, "user_id", "item_id", "score", F.col("position").alias("rank"))
    skip = excluded.join(users.select("user_id").distinct() if by else users, "user_id", "left_semi").join(
        ranked.select(*lists, "item_id", "position"), "item_id").select(*lists, "user_id", "position")
    n_skip = skip.groupBy(*lists, "user_id").agg(F.count(F.lit(1)).alias("n"))
    reach = users.join(n_skip, [*lists, "user_id"], "left").select(
        *lists, "user_id", (F.lit(k) + F.coalesce("n", F.lit(0))).cast("long").alias("reach"))
    longest = scalar_row(n_skip, n=F.coalesce(F.max("n"), F.lit(0)))["n"] + k
    spots = reach.select(*lists, "user_id", F.explode(F.sequence(F.lit(1).cast("long"), "reach")).alias("position"))
    free = spots.join(skip, [*lists, "user_id", "position"], "left_anti")
    listed = free.join(ranked.filter(F.col("position") <= longest), [*lists, "position"])
    order = Window.partitionBy(*lists, "user_id").orderBy("position")
    return listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        *lists, "user_id", "item_id", "score", "rank")


def with_attributes(recs: DataFrame, items: DataFrame, algorithm: str) -> DataFrame:
    dim = items.select("item_id", "item_name", "category_id", "brand", F.round("price", 2).alias("price"))
    return recs.join(dim, "item_id", "left").select(
        "user_id", "item_id", "rank", "score", "item_name", "category_id", F.coalesce("brand", F.lit("")).alias("brand"),
        "price", F.lit(REASONS[algorithm]).alias("reason"))


def scaled(scores: DataFrame) -> DataFrame:
    """Min-max over all rows of an item score table."""
    spread = scores.withColumn("_r", scalar_row(scores, low=F.min("score"), high=F.max("score")))
    return spread.select("item_id", min_max("score", "_r.low", "_r.high").alias("score"))


# ---- popular ---------------------------------------------------------------------------------
def decayed_components(behaviors: DataFrame, cfg: RecommendSettings, ref: Column) -> DataFrame:
    """Decayed weight per item and behaviour type; (item, type, day) is counted before the decay."""
    daily = behaviors.filter(F.col("behavior_type").isin(list(BEHAVIOR_TYPES))).groupBy(
        "item_id", "behavior_type", "event_date").agg(F.count(F.lit(1)).alias("n"))
    value = F.col("n") * time_decay(ref, "event_date", cfg.half_life_days) * weight_of("behavior_type", cfg.weights)
    return daily.groupBy("item_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("behavior_type") == t, value)), F.lit(0.0)).alias(t) for t in BEHAVIOR_TYPES])


def popular_scores(behaviors: DataFrame, cfg: RecommendSettings = RecommendSettings(), ref: Column | None = None) -> DataFrame:
    """Each type scaled by its own maximum, weighted, summed, then min-max over items seen."""
    ref = reference_day(behaviors, cfg) if ref is None else ref
    parts = decayed_components(behaviors, cfg, ref)
    topped = parts.withColumn("_top", scalar_row(parts, **{t: F.max(t) for t in BEHAVIOR_TYPES}))
    total = F.lit(0.0)
    seen = F.lit(False)
    for t in BEHAVIOR_TYPES:
        top = F.col(f"_top.{t}")
        total = total + by_maximum(t, top) * F.lit(float(cfg.weights.get(t, 0.0)))
        seen = seen | (F.col(t) > 0)
    return scaled(topped.filter(seen).select("item_id", total.alias("score")))


def popular_scores_by_weights(behaviors: DataFrame, sets: dict[str, dict[str, float]], by: str, cfg: RecommendSettings = RecommendSettings(),
                              ref: Column | None = None) -> DataFrame:
    """(``by``, item_id, score): ``popular_scores`` under several sets of weights, from one pass over the behaviours.

    A weight cancels when a type is scaled by its maximum, so the scaled components are the same for all sets; they are made once, and
    the sets join them as rows.
    """
    ref = reference_day(behaviors, cfg) if ref is None else ref
    plain = replace(cfg, weights={t: 1.0 for t in BEHAVIOR_TYPES})
    parts = decayed_components(behaviors, plain, ref)
    topped = parts.withColumn("_top", scalar_row(parts, **{t: F.max(t) for t in BEHAVIOR_TYPES}))
    shares = topped.select("item_id", *[by_maximum(t, F.col(f"_top.{t}")).alias(t) for t in BEHAVIOR_TYPES])
    rows = F.array(*[F.struct(F.lit(n).alias(by), *[F.lit(float(w.get(t, 0.0))).alias(f"w_{t}") for t in BEHAVIOR_TYPES]) for n, w in sets.items()])
    each = shares.select("*", F.inline(rows))
    total, seen = F.lit(0.0), F.lit(False)
    for t in BEHAVIOR_TYPES:
        total = total + F.col(t) * F.col(f"w_{t}")
        seen = seen | ((F.col(t) > 0) & (F.col(f"w_{t}") > 0))
    scored = cut_lineage(each.filter(seen).select(by, "item_id", total.alias("score")))
    spread = scored.groupBy(by).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return scored.join(spread, by).select(by, "item_id", min_max("score", "low", "high").alias("score"))


# ---- weights and neighbours ------------------------------------------------------------------
def user_item_weights(behaviors: DataFrame, cfg: RecommendSettings) -> DataFrame:
    weight = weight_of("behavior_type", cfg.weights)
    return behaviors.groupBy("user_id", "item_id").agg(F.sum(weight).alias("w")).filter(F.col("w") > 0)


def decayed_user_items(behaviors: DataFrame, cfg: RecommendSettings, ref: Column) -> DataFrame:
    value = weight_of("behavior_type", cfg.weights) * time_decay(ref, "event_date", cfg.half_life_days)
    return behaviors.groupBy("user_id", "item_id").agg(F.sum(value).alias("w")).filter(F.col("w") > 0)


def _item_products(weights: DataFrame) -> tuple[products.Axis, products.Axis, DataFrame, DataFrame]:
    """User and item axes, the weights in blocks, and all directed item cosines (seed, candidate) in blocks.

    The seed's norm is the plain one, the candidate's has the small addition.
    """
    norms = weights.groupBy("item_id").agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    users = products.axis(weights.select("user_id").distinct(), "user_id")
    items = products.axis(norms, "item_id")
    parts = weights.join(norms, "item_id").select(
        "user_id", "item_id", "w", (F.col("w") / F.sqrt("sq")).alias("seed"), (F.col("w") / F.sqrt(F.col("sq") + EPSILON)).alias("partner"))
    own, seed, partner = (cut_lineage(products.packed(parts, users, items, c)) for c in ("w", "seed", "partner"))
    return users, items, own, products.multiply(products.turned(seed), partner)


def item_similarity(weights: DataFrame) -> DataFrame:
    """Directed cosine (a, b, sim), each item with itself included: item blocks times user blocks, summed per pair of item blocks."""
    _, items, _, sims = _item_products(weights)
    return products.unpacked(sims, items, items, "a", "b", "sim")


def itemcf_scores(weights: DataFrame, shelf: DataFrame | None = None) -> DataFrame:
    """Score of every item that shares a user with one of the user's own: user blocks times the cosine blocks."""
    users, items, own, sims = _item_products(weights)
    scores = products.unpacked(products.multiply(own, sims), users, items, "user_id", "item_id", "score")
    return scores if shelf is None else scores.join(shelf, "item_id", "left_semi")


def itemcf_heads(weights: DataFrame, shelf: DataFrame, bought: DataFrame | None, k: int) -> DataFrame:
    """The part of ``itemcf_scores`` that can reach a list: the best ``k`` allowed items of a user in every item block.

    Items off the shelf leave the right-hand side, purchases are hidden in the summed blocks, and only the best of each row
    leave a task, so there is no table of users x items.
    """
    users, items, own, sims = _item_products(weights)
    off = cut_lineage(items.place(items.table.select("item_id").join(shelf, "item_id", "left_anti"), "k", "_c").groupBy("k").agg(
        F.collect_set("_c").alias("off")))
    sims = sims.join(off, "k", "left").select("i", "k", F.expr(
        f"filter(arrays_zip(at, v), e -> not array_contains(coalesce(off, cast(array() as array<int>)), e.at % {products.BLOCK}))").alias("e")).select(
        "i", "k", F.col("e.at").alias("at"), F.col("e.v").alias("v"))
    hidden = None if bought is None else cut_lineage(products.packed(bought.withColumn("one", F.lit(1.0)), users, items, "one"))
    best = products.multiply(own, sims, top=k, hidden=hidden, decimals=6)
    return products.unpacked(best, users, items, "user_id", "item_id", "score")


def user_neighbors(weights: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most similar other users by cosine, lower ids first on ties.

    Users lie in blocks with those of the same heaviest item.  The block a user lies in gives a first n-th cosine; as long as a user's
    heaviest items leave a rest lighter than that, no user without one of these items can do better, so
    only block pairs that share such an item are multiplied.  Groups of blocks meet in cells, and only the best ``n`` per user leave a cell.
    """
    weights = cut_lineage(weights)  # read several times
    norms = cut_lineage(weights.groupBy("user_id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norms"), F.max_by("item_id", F.struct("w", "item_id")).alias("anchor")))
    users = products.axis(norms, "user_id", near="anchor")
    items = products.axis(weights.select("item_id").distinct(), "item_id")
    blocks = cut_lineage(products.whole_rows(weights, users, items, "w"))
    about = cut_lineage(users.ids().join(users.arrays(norms, "norms", "double"), "block"))

    same = blocks.select("i", F.col("i").alias("j"))
    mine = products.nearest_rows(blocks, about, same, n, 1, hair=EPSILON)
    bound = users.table.join(mine.select(F.col("i").alias("block"), F.posexplode("bound").alias("at", "bound")), ["block", "at"]).select(
        "user_id", "bound")
    # the heaviest items, until the rest is lighter than the bound (less a hair for the rounding of sums)
    order = Window.partitionBy("user_id").orderBy(F.desc("w"), "item_id").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum(F.col("w") * F.col("w")).over(order), F.lit(0.0)) / (F.col("norms") * F.col("norms"))
    heads = weights.join(norms, "user_id").join(bound, "user_id", "left").withColumn("rest", F.lit(1.0) - share).filter(
        F.col("rest") >= F.coalesce(F.col("bound") * F.col("bound"), F.lit(0.0)) - 1e-6).select("user_id", "item_id")
    others = cut_lineage(products.reachable_pairs(blocks, heads, users, items).join(same, ["i", "j"], "left_anti"))
    more = products.nearest_rows(blocks, about, others, n, products.group_size(blocks), mine.select("i", "bound"), EPSILON)
    return products.merged_rows(mine.unionByName(more), users, "user_id", "neighbor_id", n)


def usercf_scores(weights: DataFrame, n: int = 50) -> DataFrame:
    near = user_neighbors(weights, n).select("user_id", "neighbor_id", "sim")
    theirs = weights.select(F.col("user_id").alias("neighbor_id"), "item_id", "w")
    return products.mixed_rows(near, theirs, "user_id", "neighbor_id", "item_id", "sim", "w", "score")


# ---- content ---------------------------------------------------------------------------------
def content_features(items: DataFrame, bins: int = 4) -> DataFrame:
    """Long item vectors: category, brand and price bin as 1, name tokens as unit TF-IDF."""
    flat = items.select("item_id", "item_name", "category_id", "brand", F.col("price").cast("double").alias("price"))
    edges = quantile_edges(flat.filter(F.col("price").isNotNull()), "price", bins)
    one_hot = flat.withColumn("edges", edges).select("item_id", F.explode(F.array(
        F.concat(F.lit("category="), F.coalesce(F.col("category_id").cast("string"), F.lit(""))),
        F.concat(F.lit("brand="), F.coalesce("brand", F.lit(""))),
        F.concat(F.lit("price="), F.coalesce(bin_index(F.col("price"), F.col("edges")).cast("string"), F.lit("-1"))),
    )).alias("feature")).withColumn("value", F.lit(1.0))
    words = F.regexp_extract_all(F.coalesce("item_name", F.lit("")), F.lit("([\\u4e00-\\u9fffA-Za-z0-9]+)"), F.lit(1))
    kept = F.filter(words, lambda t: ~F.coalesce(t == F.col("brand"), F.lit(False)))
    tf = flat.select("item_id", F.explode(kept).alias("token")).groupBy(
        "item_id", F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("tf"))
    n = scalar_row(items, n=F.count(F.lit(1)))["n"]
    idf = tf.groupBy("token").agg((F.log((n + 1.0) / (F.count(F.lit(1)) + 1.0)) + 1.0).alias("idf"))
    raw = tf.join(idf, "token").select("item_id", "token", (F.col("tf") * F.col("idf")).alias("v"))
    norm = raw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    tokens = raw.join(norm, "item_id").select(
        "item_id", F.concat(F.lit("token="), "token").alias("feature"), (F.col("v") / F.col("norm")).alias("value"))
    return one_hot.unionByName(tokens)


def user_seeds(behaviors: DataFrame, cfg: RecommendSettings, ref: Column | None = None) -> DataFrame:
    """The heaviest recent items of each user."""
    ref = reference_day(behaviors, cfg) if ref is None else ref
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("w", 9)), "item_id")
    return decayed_user_items(behaviors, cfg, ref).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= cfg.seeds).select("user_id", "item_id", "w")


def _taste_and_vectors(seeds: DataFrame, features: DataFrame, shelf: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One sparse taste vector per user, its size bounded by the number of seeds, and the vectors of the shelf."""
    norms = features.groupBy("item_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    vectors = features.join(norms, "item_id")
    taste = seeds.join(vectors, "item_id").groupBy("user_id", "feature").agg(
        F.sum(F.col("w") * F.col("value") / F.col("norm")).alias("t"))
    side = vectors if shelf is None else vectors.join(shelf, "item_id", "left_semi")
    return taste, side.select("item_id", "feature", (F.col("value") / (F.col("norm") + EPSILON)).alias("v"))


def content_scores(seeds: DataFrame, features: DataFrame, shelf: DataFrame | None = None) -> DataFrame:
    """Sum of seed weight times cosine, for every user and every item that shares a feature: the whole table."""
    return content_table(*_taste_and_vectors(seeds, features, shelf))


def content_heads(seeds: DataFrame, features: DataFrame, shelf: DataFrame, bought: DataFrame | None, k: int) -> DataFrame:
    """The part of ``content_scores`` that can reach a list of ``k``: the best ``k`` allowed items of a user in every cell.

    Every pair is scored.  On dense features the index with bounds (``postings.best_scores``) opens most of the shelf, and its
    (user, shape, feature) rows outgrow the disk.
    """
    taste, side = _taste_and_vectors(seeds, features, shelf)
    return content_best(taste, side, bought, k)


# ---- recommenders ----------------------------------------------------------------------------
def _context(behaviors, items, orders, order_items, cfg):
    shelf = on_shelf(items, cfg)
    bought = purchased(orders, order_items, cfg.purchased_until) if cfg.drop_purchased else None
    return shelf, bought


def recommend_popular(behaviors, items, orders, order_items, users, cfg=RecommendSettings(), ref=None) -> DataFrame:
    shelf, bought = _context(behaviors, items, orders, order_items, cfg)
    scores = popular_scores(behaviors, cfg, ref).join(shelf, "item_id", "left_semi")
    return global_heads(scores, users.select("user_id").distinct(), bought, cfg.top_k).withColumn("score", F.round("score", 4))


def _with_fallback(scored, fallback, users, known, shelf, bought, k) -> DataFrame:
    """Personal lists for the users in ``known``, the global list for all others.

    A personal list that ends before ``k`` is topped up from the global list, behind the personal part, with score 0.
    """
    known = known.select("user_id").distinct()
    personal = cut_lineage(top_k(candidates(scored.join(users, "user_id", "left_semi"), shelf, bought), k))
    cold = users.join(known, "user_id", "left_anti")
    own = fallback.join(shelf, "item_id", "left_semi")
    lists = global_heads(own, cold, bought, k)
    full = personal.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    short = cut_lineage(users.join(known, "user_id", "left_semi").join(full, "user_id", "left").fillna(0, ["n"]).filter(F.col("n") < k))
    listed = personal.select("user_id", "item_id").join(short, "user_id", "left_semi")
    taken = listed if bought is None else listed.unionByName(bought).distinct()
    more = global_heads(own, short.select("user_id"), taken, k).join(short, "user_id").withColumn(
        "rank", F.col("rank") + F.col("n")).filter(F.col("rank") <= k).withColumn("score", F.lit(0.0))
    rest = [df.select("user_id", "item_id", F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score")) for df in (lists, more)]
    return personal.unionByName(rest[0]).unionByName(rest[1])


def _item_totals(weights: DataFrame) -> DataFrame:
    return scaled(weights.groupBy("item_id").agg(F.sum("w").alias("score")))


def recommend_itemcf(behaviors, items, orders, order_items, users, cfg=RecommendSettings(), ref=None) -> DataFrame:
    shelf, bought = _context(behaviors, items, orders, order_items, cfg)
    weights = user_item_weights(behaviors, cfg)
    return _with_fallback(itemcf_heads(weights, shelf, bought, cfg.top_k), _item_totals(weights), users.select("user_id").distinct(),
                          weights, shelf, bought, cfg.top_k)


def recommend_usercf(behaviors, items, orders, order_items, users, cfg=RecommendSettings(), ref=None) -> DataFrame:
    shelf, bought = _context(behaviors, items, orders, order_items, cfg)
    weights = cut_lineage(user_item_weights(behaviors, cfg))
    return _with_fallback(usercf_scores(weights, cfg.neighbors), _item_totals(weights),
                          users.select("user_id").distinct(), weights, shelf, bought, cfg.top_k)


def recommend_content(behaviors, items, orders, order_items, users, cfg=RecommendSettings(), ref=None) -> DataFrame:
    shelf, bought = _context(behaviors, items, orders, order_items, cfg)
    ref = reference_day(behaviors, cfg) if ref is None else ref
    seeds = cut_lineage(user_seeds(behaviors, cfg, ref))
    scored = content_heads(seeds, cut_lineage(content_features(items, cfg.price_bins)), shelf, bought, cfg.top_k)
    fallback = scaled(decayed_user_items(behaviors, cfg, ref).groupBy("item_id").agg(F.sum("w").alias("score")))
    return _with_fallback(scored, fallback, users.select("user_id").distinct(), seeds, shelf, bought, cfg.top_k)


def hybrid_scores(behaviors, items, orders, order_items, users, cfg=RecommendSettings(), ref=None, top: int | None = None) -> DataFrame:
    """Blended scores of users with a history; with ``top`` only the rows that can reach a list of so many.

    Every part is min-max scaled over the user's own candidates, all items on the shelf that the user has not bought.  Content scores are
    made where they are blended, in cells of users and items, and never stand as rows.
    """
    shelf, bought = _context(behaviors, items, orders, order_items, cfg)
    ref = reference_day(behaviors, cfg) if ref is None else ref
    weights = cut_lineage(user_item_weights(behaviors, cfg))
    wanted = users.select("user_id").distinct().join(weights.select("user_id").distinct(), "user_id", "left_semi")
    taste, side = _taste_and_vectors(cut_lineage(user_seeds(behaviors, cfg, ref)), cut_lineage(content_features(items, cfg.price_bins)), shelf)
    scores = {"itemcf": cut_lineage(itemcf_scores(weights, shelf)), "usercf": cut_lineage(usercf_scores(weights, cfg.neighbors))}
    popular = cut_lineage(popular_scores(behaviors, cfg, ref))
    return blended(taste, side, wanted, scores, popular, bought, cfg.blend, top)


def cold_blend(behaviors, items, cfg=RecommendSettings(), ref=None) -> DataFrame:
    """Global blend for users without a history: both neighbour parts fall back to item totals."""
    ref = reference_day(behaviors, cfg) if ref is None else ref
    shelf = on_shelf(items, cfg)
    weights = user_item_weights(behaviors, cfg)
    recent = decayed_user_items(behaviors, cfg, ref).groupBy("item_id").agg(F.sum("w").alias("score"))
    parts = {"popular": popular_scores(behaviors, cfg, ref), "content": scaled(recent),
             "itemcf": _item_totals(weights), "usercf": _item_totals(weights)}
    stacked = reduce(DataFrame.unionByName, [
        df.join(shelf, "item_id", "left_semi").select("item_id", "score", F.lit(n).alias("part")) for n, df in parts.items()])
    wide = shelf.join(stacked, "item_id", "left").groupBy("item_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("part") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in parts])
    wide = cut_lineage(wide)
    spread = wide.withColumn("_r", scalar_row(
        wide, **{f"lo_{n}": F.min(n) for n in parts}, **{f"hi_{n}": F.max(n) for n in parts}))
    total = F.lit(0.0)
    for n in parts:
        total = total + min_max(n, f"_r.lo_{n}", f"_r.hi_{n}") * F.lit(float(cfg.blend.get(n, 0.0)))
    return spread.select("item_id", total.alias("score")).filter(F.col("score") > 0)


def recommend_hybrid(behaviors, items, orders, order_items, users, cfg=RecommendSettings(), ref=None) -> DataFrame:
    scored = hybrid_scores(behaviors, items, orders, order_items, users, cfg, ref, cfg.top_k)
    weights = user_item_weights(behaviors, cfg)
    cold = users.select("user_id").distinct().join(weights.select("user_id").distinct(), "user_id", "left_anti")
    _, bought = _context(behaviors, items, orders, order_items, cfg)
    lists = global_heads(cold_blend(behaviors, items, cfg, ref), cold, bought, cfg.top_k)
    return top_k(scored, cfg.top_k).unionByName(lists.select(
        "user_id", "item_id", F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score")))


RECOMMENDERS = {
    "popular": recommend_popular, "itemcf": recommend_itemcf, "usercf": recommend_usercf,
    "content": recommend_content, "hybrid": recommend_hybrid,
}


def recommend(algorithm: str, behaviors, items, orders, order_items, users, cfg=RecommendSettings(), ref=None) -> DataFrame:
    recs = RECOMMENDERS[algorithm](behaviors, items, orders, order_items, users, cfg, ref)
    return with_attributes(recs, items, algorithm)
