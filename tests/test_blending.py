"""Content scores and blended lists made in cells, against everything scored row by row."""

import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import blending
from stallwise.operators import recommend as H
from stallwise.settings import RecommendSettings

NEW = "2026-01-01T00:00:00"


def shop_of(make, seed, items):
    dice = random.Random(seed)
    words = ["red", "blue", "old", "new", "lamp", "shoe"]
    return make.items([(f"I{i:04d}", " ".join(dice.sample(words, dice.randrange(0, 3))), f"C{dice.randrange(4)}", f"b{dice.randrange(5)}",
                        dice.randrange(1, 30), int(dice.random() > 0.1), NEW) for i in range(items)])


def world_of(make, seed, users, active, bought, items):
    dice = random.Random(seed)
    b = make.behaviors([(f"B{n}", f"U{dice.randrange(users):03d}", f"I{dice.randrange(active):04d}", dice.choice(["pv", "click", "buy"]),
                         f"2026-08-{1 + n % 28:02d}T10:00:00") for n in range(users * 6)])
    pairs = [(f"U{dice.randrange(users):03d}", f"I{dice.randrange(items):04d}") for _ in range(bought)]
    orders = make.orders([(f"O{n}", u, "2026-08-03T10:00:00", 5, "paid") for n, (u, _) in enumerate(pairs)])
    lines = make.lines([(f"O{n}", i, 1, 5) for n, (_, i) in enumerate(pairs)])
    users = make.users([(f"U{u:03d}", 30, "F", NEW) for u in range(users + 3)])
    return b, shop_of(make, seed + 1, items), orders, lines, users


def row_by_row(b, items, orders, lines, users, cfg):
    """{(user, item): blended score} of every candidate with a score in any part."""
    shelf, bought = H._context(b, items, orders, lines, cfg)
    shelf, bought = {r.item_id for r in shelf.collect()}, {tuple(r) for r in bought.collect()}
    weights = H.user_item_weights(b, cfg)
    taste, side = H._taste_and_vectors(H.user_seeds(b, cfg), H.content_features(items, cfg.price_bins), None)
    content = taste.join(side, "feature").groupBy("user_id", "item_id").agg(F.sum(F.col("t") * F.col("v")).alias("score"))
    tables = {n: {(r.user_id, r.item_id): r.score for r in df.collect()} for n, df in (
        ("itemcf", H.itemcf_scores(weights)), ("usercf", H.usercf_scores(weights, cfg.neighbors)), ("content", content))}
    popular = {r.item_id: r.score for r in H.popular_scores(b, cfg).collect()}
    out = {}
    for u in {r.user_id for r in weights.select("user_id").distinct().collect()}:
        seen = [i for i in sorted(shelf) if (u, i) not in bought]
        parts = {n: {i: t[u, i] for i in seen if (u, i) in t} for n, t in tables.items()} | {"popular": {i: popular[i] for i in seen if i in popular}}
        total = dict.fromkeys(seen, 0.0)
        for n, p in parts.items():
            values = [p.get(i, 0.0) for i in seen]
            low, high = min(values), max(values)
            for i, v in zip(seen, values):
                total[i] += cfg.blend[n] * ((v - low) / (high - low) if high > low else 0.0)
        out |= {(u, i): total[i] for i in seen if any(i in p for p in parts.values())}
    return out


@pytest.mark.parametrize("users, active, bought, items, narrow", [(40, 30, 60, 700, 512), (25, 300, 300, 300, 3), (600, 20, 5, 90, 512)])
def test_blend_is_that_of_all_rows(make, monkeypatch, users, active, bought, items, narrow):
    monkeypatch.setattr(blending, "NARROW", narrow)
    cfg = RecommendSettings(neighbors=7)
    args = world_of(make, users, users, active, bought, items)
    want = row_by_row(*args, cfg)
    got = {(r.user_id, r.item_id): r.score for r in H.hybrid_scores(*args, cfg).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    listed = {}
    for (u, i), s in want.items():
        listed.setdefault(u, []).append((-round(s, 6), i))
    best = H.top_k(H.hybrid_scores(*args, cfg, top=10), 10).collect()
    assert sorted((r.user_id, r["rank"], r.item_id) for r in best) == sorted(
        (u, n, i) for u, x in listed.items() for n, (_, i) in enumerate(sorted(x)[:10], 1))


def test_lists_write_no_table_of_users_and_items(make, monkeypatch, tmp_path):
    """120 users see 6,000 items: the 648,000 scores must not be written on the way to lists of ten."""
    args = world_of(make, 3, 120, 20, 30, 6000)
    monkeypatch.setattr("stallwise.session.scratch_base", lambda spark: str(tmp_path))
    lists = H.recommend_hybrid(*args)
    assert lists.count() == 1230
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 3_000_000


def test_all_content_scores_without_a_user_name(make, spark):
    items = shop_of(make, 8, 60)
    features = H.content_features(items, 4)
    seeds = spark.createDataFrame([("U1", "I0003", 2.0), (None, "I0004", 1.0), ("U2", "I0005", 0.5)], "user_id string, item_id string, w double")
    taste, side = H._taste_and_vectors(seeds, features, None)
    rows = taste.join(side, "feature").groupBy("user_id", "item_id").agg(F.sum(F.col("t") * F.col("v")).alias("score"))
    as_rows = lambda df: {(r.user_id, r.item_id): round(r.score, 9) for r in df.collect()}
    assert as_rows(H.content_scores(seeds, features)) == as_rows(rows)


def test_content_lists_write_no_rows_of_users_and_features(make, monkeypatch, tmp_path):
    """150 users whose tastes hold every feature of a shelf of 3,000 items: neither pairs nor their postings may be written or shuffled as rows."""
    b, items, orders, lines, users = world_of(make, 5, 150, 100, 40, 3000)
    monkeypatch.setattr("stallwise.session.scratch_base", lambda spark: str(tmp_path))
    cfg = RecommendSettings()
    shelf, bought = H._context(b, items, orders, lines, cfg)
    heads = H.content_heads(H.user_seeds(b, cfg), H.content_features(items, cfg.price_bins), shelf, bought, 10)
    assert "FlatMapCoGroupsInArrow" in heads._jdf.queryExecution().toString()
    assert H.top_k(H.candidates(heads, shelf, bought), 10).count() == 1500
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 1_500_000
