"""Skew-safe helpers against brute force, with block and bucket sizes small enough to matter."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from stallwise.functions.pairing import pair_sums
from stallwise.functions.scalar import safe_div
from stallwise.functions.sequence import running_total, sessions
from stallwise.operators.models import classification_metrics
from stallwise.operators.recommend import global_heads
from stallwise.settings import BEHAVIOR_WEIGHTS, parse_weights


def test_safe_div(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [0.3333, 0.0, 0.0]


def test_parse_weights():
    assert parse_weights("pv:1,click:2.5") == {"pv": 1.0, "click": 2.5}
    assert parse_weights('{"buy": 9}') == {"buy": 9.0}
    assert parse_weights({"pv": 1, "other": 2}) == {"pv": 1.0, "other": 2.0}
    assert parse_weights("") == parse_weights({}) == parse_weights(None) == parse_weights("nonsense") == BEHAVIOR_WEIGHTS
    with pytest.raises(ValueError):
        parse_weights("pv:1,buy:much")


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_pair_sums_with_a_hot_group(spark, block_rows):
    """One group holds most rows and is cut into blocks; every pair is still met exactly once."""
    rng = random.Random(7)
    rows = [("hot", m, rng.randint(1, 5)) for m in range(40)]
    rows += [(f"g{g}", m, rng.randint(1, 5)) for g in range(10) for m in rng.sample(range(40), 3)]
    groups = defaultdict(dict)
    for g, m, v in rows:
        groups[g][m] = v
    want = defaultdict(lambda: [0, 0.0])
    for members in groups.values():
        for a in members:
            for b in members:
                if a < b:
                    want[a, b][0] += 1
                    want[a, b][1] += members[a] * members[b]
    df = spark.createDataFrame(rows, "g string, m int, v int")
    got = {(r["a"], r["b"]): [r["shared"], r["dot"]] for r in pair_sums(df, "g", "m", "v", block_rows).collect()}
    assert got == dict(want)


def test_sessions_match_a_plain_scan(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows, n = [], 0
    for user in range(5):
        t = start
        for _ in range(60 if user else 400):
            t += timedelta(minutes=rng.choice([1, 5, 29, 30, 31, 90, 600]))
            rows.append((user, n, t))
            n += 1
    want, last, begin = {}, {}, {}
    for user, i, t in rows:
        if user not in last or t - last[user] > timedelta(minutes=30):
            begin[user] = t
        last[user] = t
        want[i] = begin[user]
    df = spark.createDataFrame(rows, "user_id int, behavior_id int, event_time timestamp_ntz")
    got = {r["behavior_id"]: r["session_start"] for r in sessions(df, 30).collect()}
    assert got == want


def test_running_total(spark):
    rows = [(i % 7, i, i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "bucket int, place int, x int")
    total, want = 0, {}
    for b, p, x in sorted(rows):
        total += x
        want[p] = total
    got = {r["place"]: r["cum_x"] for r in running_total(df, "bucket", ["place"], ["x"]).collect()}
    assert got == want


def test_areas_match_pair_counting(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, seen_p, seen = 0.0, 0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        here = sum(1 for p in pos if p == s)
        seen_p += here
        seen += here + sum(1 for q in neg if q == s)
        ap += here / len(pos) * seen_p / seen
    row = classification_metrics(spark.createDataFrame(rows, "label int, probability double")).first()
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-4) and row["pr_auc"] == pytest.approx(ap, abs=1e-4)
    one_class = classification_metrics(spark.createDataFrame([(1, 0.9)], "label int, probability double")).first()
    assert one_class["roc_auc"] is None and one_class["tp"] == 1


def test_global_heads_skip_what_a_user_has(spark):
    scores = spark.createDataFrame([(i, 1.0 - i / 100) for i in range(50)], "item_id int, score double")
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    excluded = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 1)], "user_id int, item_id int")
    got = defaultdict(list)
    for r in global_heads(scores, users, excluded, 3).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append(r["item_id"])
    assert got == {1: [30, 31, 32], 2: [0, 2, 3]}
