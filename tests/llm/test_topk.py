import math
import random

from pyspark.sql import functions as F

from stallwise.llm import topk


def best(vectors, queries, top=5):
    out = []
    for q, qv in queries:
        scored = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for c, cv in vectors if c != q)
        out += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:top], 1)]
    return sorted(out)


def usable(rows):
    return [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("n", F.lit(2))


def test_against_brute_force(spark):
    dice = random.Random(1)
    rows = [(i, [dice.choice([0.0, 0.25, -0.5, 0.75]) for _ in range(40)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    rows += [(2000, None), (2050, []), (2100, [0.5, None]), (2150, [float("nan")] * 40), (2200, [float("inf")] * 40), (None, [1.0] * 40),
             (2250, [1.0, -1.0])]
    vectors = frame(spark, rows).repartition(5)
    got = topk.top_products(vectors, vectors.where("vec_id % 50 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    known = usable(rows)
    assert sorted(map(tuple, got.collect())) == best(known, [(i, v) for i, v in known if i % 50 == 0])


def test_pruning_keeps_the_best():
    import numpy as np

    dice = np.random.default_rng(4)
    cand = np.floor(256 * dice.standard_normal((48, 900)) * np.linspace(3, 0.05, 48)[:, None])
    query = cand[:, :20]
    ids = np.arange(900)
    got = sorted(topk.best_of_cell(ids, cand, ids[:20], query))
    full = cand.T @ query
    for q in range(20):
        mine = [(i, s) for at, i, s in got if at == q]
        want = sorted(((-full[c, q], c) for c in range(900) if c != q))[:5]
        assert sorted(mine, key=lambda x: (-x[1], x[0])) == [(c, int(-s)) for s, c in want]


def test_huge_components_fewer_candidates_and_no_rows(spark):
    rows = [(0, [1e12, 2.0]), (1, [1e12, -1e9]), (50, [-3.0, 4.0])]
    vectors = frame(spark, rows)
    got = topk.top_products(vectors, vectors.where("vec_id % 50 = 0")).collect()
    clipped = [(q, n, c, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, c, s in best(
        [(i, [math.floor(256 * float(__import__("numpy").float32(x))) for x in v]) for i, v in rows],
        [(i, [math.floor(256 * float(__import__("numpy").float32(x))) for x in v]) for i, v in rows if i % 50 == 0])]
    assert sorted(map(tuple, got)) == clipped
    assert topk.top_products(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_products(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")).count() == 0


def test_many_cells_and_no_side_sent_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "CELL", 4000)
    monkeypatch.setattr(topk, "ASKED", 300)
    monkeypatch.setattr(topk, "PIECE", 900)
    dice = random.Random(6)
    rows = [(i, [dice.choice([0.0, 0.25, -0.5, 0.75, 200.0 * (i % 9 == 0)]) for _ in range(20)]) for i in range(900)]
    rows += [(150, rows[3][1]), (150, rows[3][1])]
    vectors = frame(spark, rows).repartition(3)
    got = topk.top_products(vectors, vectors.where("vec_id % 50 = 0"))
    assert "BroadcastExchange" not in got._jdf.queryExecution().toString()
    known = usable(rows)
    assert sorted(map(tuple, got.collect())) == best(known, [(i, v) for i, v in known if i % 50 == 0])


def test_thresholds_brought_along_lose_nothing():
    import numpy as np

    dice = np.random.default_rng(5)
    cand = np.floor(256 * dice.standard_normal((40, 3000)) * np.linspace(3, 0.05, 40)[:, None])
    cand[:, 2000:2100] = cand[:, 100:200]
    query, ids = cand[:, :30], np.arange(3000)
    scores = cand.T @ query
    scores[np.arange(30), np.arange(30)] = -np.inf
    reached = np.sort(scores, axis=0)[-5]
    got = [(q, i, s) for q, i, s in topk.best_of_cell(ids, cand, ids[:30], query, reached=reached)]
    want = [(q, int(c), int(scores[c, q])) for q in range(30) for c in np.lexsort((ids, -scores[:, q]))[:5]]
    assert got == want
