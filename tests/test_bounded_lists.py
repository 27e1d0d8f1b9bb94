"""Blocked sparse products and lists found with bounds, against everything scored."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.functions import products
from stallwise.operators import postings
from stallwise.operators import recommend as H
from stallwise.settings import RecommendSettings

NEW = "2026-01-01T00:00:00"


def table(spark, cells):
    return spark.createDataFrame([(f"r{r:04d}", f"c{c:04d}", float(v)) for (r, c), v in cells.items()], "row string, col string, v double")


def cells_of(seed, rows, columns, filled):
    dice = random.Random(seed)
    return {(dice.randrange(rows), min(dice.randrange(columns), dice.randrange(columns))): dice.randrange(1, 9) for _ in range(filled)}


@pytest.mark.parametrize("dense", [0, 1 << 60])
def test_product_of_two_packed_blocks(dense, monkeypatch):
    monkeypatch.setattr(products, "DENSE", dense)
    dice = np.random.default_rng(1)
    left, right = (np.where(dice.random((products.BLOCK, products.BLOCK)) < 0.02, dice.integers(1, 9, (products.BLOCK,) * 2), 0.0) for _ in range(2))
    total = np.ones((products.BLOCK, products.BLOCK))
    pack = lambda m: (np.flatnonzero(m).astype(np.int32), m.ravel()[np.flatnonzero(m)])
    products.add_product(total, *pack(left), *pack(right))
    assert np.allclose(total, 1 + left @ right)


def test_best_of_rows_breaks_ties_by_id():
    total = np.zeros((products.BLOCK, products.BLOCK))
    total[3, [1, 2, 5, 3]] = [2, 2, 7, 9]
    total[4, 9] = -np.inf
    ids = np.arange(products.BLOCK)[::-1].copy()
    rows, columns = products.best_of_rows(total, 2, ids, skip_same=True, decimals=9)
    assert list(zip(rows, columns)) == [(3, 5), (3, 2)]


def test_axis_counts_in_order_and_places_neighbours_together(spark):
    keys = spark.createDataFrame([(f"k{i:05d}", f"n{i % 7}") for i in range(1300)], "key string, near string").repartition(5)
    rows = products.axis(keys, "key", near="near").table.orderBy("key").collect()
    assert [r.id for r in rows] == list(range(1300))
    place = [r.block * products.BLOCK + r["at"] for r in rows]
    assert sorted(place) == list(range(1300))
    by_place = sorted(range(1300), key=place.__getitem__)
    assert [i % 7 for i in by_place] == sorted(i % 7 for i in range(1300))


def test_products_over_several_blocks(spark):
    cells = cells_of(2, 1100, 700, 9000)
    df = table(spark, cells)
    rows, columns = products.axis(df.select("row").distinct(), "row"), products.axis(df.select("col").distinct(), "col")
    blocks = products.packed(df, rows, columns, "v")
    got = {(r.a, r.b): r.dot for r in products.unpacked(products.multiply(products.turned(blocks), blocks), columns, columns, "a", "b", "dot").collect()}
    m = np.zeros((1100, 700))
    for (r, c), v in cells.items():
        m[r, c] = v
    want = m.T @ m
    assert got == {(f"c{a:04d}", f"c{b:04d}"): want[a, b] for a, b in zip(*np.nonzero(want))}


def behaviors_of(make, seed, users, items, events):
    dice = random.Random(seed)
    rows = []
    for n in range(events):
        u = dice.randrange(users)
        i = u % 11 if dice.random() < 0.5 else min(dice.randrange(items), dice.randrange(items))  # tastes and hot items
        rows.append((f"B{n}", f"U{u:04d}", f"I{i:04d}", dice.choice(["pv", "click", "buy"]), f"2026-08-{1 + n % 28:02d}T10:00:00"))
    return make.behaviors(rows)


@pytest.mark.parametrize("n, users", [(50, 40), (7, 900)])
def test_neighbours_are_those_of_all_pairs(make, n, users):
    weights = H.user_item_weights(behaviors_of(make, 3, users, 60, users * 9), RecommendSettings())
    data = {(r.user_id, r.item_id): r.w for r in weights.collect()}
    names, things = sorted({u for u, _ in data}), sorted({i for _, i in data})
    m = np.zeros((len(names), len(things)))
    for (u, i), w in data.items():
        m[names.index(u), things.index(i)] = w
    norm = np.sqrt((m * m).sum(axis=1))
    sim = (m @ m.T) / (np.outer(norm, norm) + 1e-9)
    want = {}
    for a, name in enumerate(names):
        near = sorted((-round(sim[a, b], 9), b) for b in range(len(names)) if b != a and sim[a, b] > 0)[:n]
        want[name] = [(names[b], pytest.approx(-s, abs=1e-8)) for s, b in near]
    got = {}
    for r in H.user_neighbors(weights, n).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.neighbor_id, r.sim))
    assert got == {u: v for u, v in want.items() if v}


def shop_of(make, seed, items):
    dice = random.Random(seed)
    words = ["red", "blue", "old", "new", "lamp", "shoe", "chair", "cup"]
    return make.items([(f"I{i:04d}", " ".join(dice.sample(words, dice.randrange(0, 3))), f"C{dice.randrange(4)}", f"b{dice.randrange(9)}",
                        dice.randrange(1, 40), int(dice.random() > 0.1), NEW) for i in range(items)])


@pytest.mark.parametrize("k, items", [(10, 25), (3, 400)])
def test_content_lists_with_bounds_are_those_of_all_scores(make, spark, k, items):
    cfg = RecommendSettings(top_k=k)
    b = behaviors_of(make, 5, 30, items, 400)
    shop = shop_of(make, 6, items)
    shelf = H.on_shelf(shop, cfg)
    # purchases among the best matches, so that the first bound alone would be wrong
    seeds, features = H.user_seeds(b, cfg), H.content_features(shop, cfg.price_bins)
    scores = H.content_scores(seeds, features, shelf)
    bought = H.top_k(scores, 6).select("user_id", "item_id").unionByName(b.select("user_id", "item_id").limit(40)).distinct()
    bought = spark.createDataFrame(bought.collect(), bought.schema)
    for hidden in (bought, None):
        want = H.top_k(H.candidates(scores, shelf, hidden), k)
        got = H.top_k(H.candidates(H.content_heads(seeds, features, shelf, hidden, k), shelf, hidden), k)
        as_rows = lambda df: sorted((r.user_id, r["rank"], r.item_id, r.score) for r in df.collect())
        assert as_rows(got) == as_rows(want)


def test_bounds_leave_most_of_a_larger_shelf_unopened(make):
    cfg = RecommendSettings()
    b = behaviors_of(make, 7, 20, 60, 300)
    found = []
    for items in (300, 3000):
        shop = shop_of(make, 8, items).withColumn("status", F.lit(1))
        seeds, features = H.user_seeds(b, cfg), H.content_features(shop, cfg.price_bins)
        taste, side = H._taste_and_vectors(seeds, features, None)
        found.append(postings.best_scores(seeds, taste, features, side, None, 10, count_candidates=True).count())
    assert found[1] < 5 * found[0]


def test_item_lists_are_those_of_all_scores(make):
    cfg = RecommendSettings()
    b = behaviors_of(make, 9, 700, 600, 5000)
    shop = shop_of(make, 10, 600)
    weights, shelf = H.user_item_weights(b, cfg), H.on_shelf(shop, cfg)
    bought = b.filter("behavior_type = 'buy'").select("user_id", "item_id").distinct()
    want = H.top_k(H.candidates(H.itemcf_scores(weights), shelf, bought), 10)
    got = H.top_k(H.candidates(H.itemcf_heads(weights, shelf, bought, 10), shelf, bought), 10)
    as_rows = lambda df: sorted((r.user_id, r["rank"], r.item_id, round(r.score, 3)) for r in df.collect())
    assert as_rows(got) == as_rows(want)


def written(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_neighbours_write_no_table_of_pairs(make, monkeypatch, tmp_path):
    """Every user shares items with all others: what is written must not hold a similarity for each of the 810,000 pairs."""
    weights = H.user_item_weights(behaviors_of(make, 11, 900, 30, 18000), RecommendSettings())
    monkeypatch.setattr("stallwise.session.scratch_base", lambda spark: str(tmp_path))
    assert H.user_neighbors(weights, 3).count() == 2700
    assert written(tmp_path) < 2_000_000


def test_groups_of_blocks_that_meet_in_cells_keep_the_best(spark, monkeypatch):
    monkeypatch.setattr(products, "GROUPS", 2)
    monkeypatch.setattr(products, "COMMON", 3)
    cells = cells_of(12, 2600, 300, 30000)
    df = table(spark, cells)
    rows, columns = products.axis(df.select("row").distinct(), "row"), products.axis(df.select("col").distinct(), "col")
    blocks = products.whole_rows(df, rows, columns, "v")
    m = np.zeros((2600, 300))
    for (r, c), v in cells.items():
        m[r, c] = v
    norm = np.sqrt((m * m).sum(axis=1))
    norms = spark.createDataFrame([(f"r{r:04d}", float(x)) for r, x in enumerate(norm) if x], "row string, norms double")
    about = rows.ids().join(rows.arrays(norms, "norms", "double"), "block")
    numbers = blocks.select("i")
    pairs = numbers.crossJoin(numbers.withColumnRenamed("i", "j"))
    assert products.group_size(blocks) == 3
    near = products.merged_rows(products.nearest_rows(blocks, about, pairs, 4, 3), rows, "row", "other", 4)
    sim = np.divide(m @ m.T, np.outer(norm, norm), out=np.zeros((2600, 2600)), where=np.outer(norm, norm) > 0)
    np.fill_diagonal(sim, 0)
    want = {(f"r{r:04d}", n + 1): f"r{c:04d}" for r in range(2600) for n, c in enumerate(np.lexsort((np.arange(2600), -np.round(sim[r], 9)))[:4]) if sim[r, c] > 0}
    assert {(x.row, x["rank"]): x.other for x in near.collect()} == want


def test_rows_mixed_by_shares(spark, monkeypatch):
    near = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 2.0), ("b", "y", 1.0), ("b", "y", 1.0), ("c", "gone", 1.0), (None, "x", 1.0)], "u string, n string, s double")
    theirs = spark.createDataFrame([("x", "1", 2.0), ("x", "2", 4.0), ("y", "2", 3.0), ("y", None, 1.0), ("y", "2", 1.0), (None, "1", 9.0)], "n string, item string, w double")
    got = {(r.u, r.item): r.score for r in products.mixed_rows(near, theirs, "u", "n", "item", "s", "w", "score").collect()}
    assert got == {("a", "1"): 1.0, ("a", "2"): 10.0, ("a", None): 2.0, ("b", "2"): 8.0, ("b", None): 2.0, (None, "1"): 2.0, (None, "2"): 4.0}


def test_scores_of_similar_users_are_added_up_without_a_row_for_each_product(make):
    weights = H.user_item_weights(behaviors_of(make, 13, 300, 40, 4000), RecommendSettings())
    near = {}
    for r in H.user_neighbors(weights, 20).collect():
        near.setdefault(r.user_id, []).append((r.neighbor_id, r.sim))
    own = {}
    for r in weights.collect():
        own.setdefault(r.user_id, []).append((r.item_id, r.w))
    want = {}
    for u, others in near.items():
        for o, s in others:
            for i, w in own[o]:
                want[u, i] = want.get((u, i), 0.0) + s * w
    scores = H.usercf_scores(weights, 20)
    assert {(r.user_id, r.item_id): round(r.score, 9) for r in scores.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert "neighbor_id#" not in scores._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
