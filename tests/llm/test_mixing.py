import hashlib
import math

from pyspark.sql import functions as F

from stallwise.llm import mixing


def expected(rows):
    """Closed form: every source is taken pass by pass up to the whole part of its target."""
    sizes = [(s, k, len((t or "").split(" ")) if t else 0) for k, t, s in rows]
    names = sorted({s for s, _, _ in sizes if s is not None}) + ([None] if any(s is None for s, _, _ in sizes) else [])
    total = {n: sum(z for s, _, z in sizes if s == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[n] for n in capped)
        share = sum(weight[n] for n in names if n not in capped)
        target = {n: 3 * total[n] if n in capped else weight[n] * rest / share for n in names}
        over = {n for n in names if target[n] > 3 * total[n] and n not in capped}
        if not over:
            break
        capped |= over
    taken = []
    for n in names:
        at, upto = 0, math.floor(target[n])
        docs = sorted((hashlib.md5(("" if k is None else str(k)).encode()).hexdigest(), k or 0, z) for s, k, z in sizes if s == n)
        for _, k, z in docs:
            whole, rest = divmod(upto, total[n]) if total[n] else (0, 0)
            taken.append((n, k, z, target[n], whole * z + max(0, min(at + z, rest) - at)))
            at += z
    return taken


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))
    got = mixing.taken_words(docs).collect()
    assert sorted((r.doc_id or 0, r["size"], round(r.target, 6), r.taken) for r in got) == sorted(
        (k, z, round(t, 6), n) for _, k, z, t, n in expected(rows))
    return docs, got


def test_words_taken_follow_the_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), f"s{i % 7 % 4}") for i in range(300)]
    rows += [(1000 + i, "one two", "tiny") for i in range(3)] + [(2000, None, "s1"), (2001, "", "empty"), (2002, "a b c", None), (None, "x y", None),
                                                              (5, " ".join(["w"] * 186), "s1"), (3000, " ".join(["v"] * 40000), "s2")]
    docs, got = check(spark, rows)
    by_source = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        got_so_far = by_source.setdefault((r.source_size, r.target), 0)
        by_source[(r.source_size, r.target)] = got_so_far + r.taken
    for (size, target), taken in by_source.items():
        assert abs(taken - target) <= 1 and target <= 3 * size
    again = mixing.taken_words(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_has_low_discrepancy(spark):
    goals = spark.createDataFrame([(1, 50000, 50000.0), (2, 30000, 30000.0), (3, 20000, 20000.0)], "rank int, source_size long, target double")
    plan = sorted((r.slot, r.source_rank, r.nth) for r in mixing.schedule(spark, goals, 10).collect())
    assert [p[0] for p in plan] == list(range(10000))
    seen = {1: 0, 2: 0, 3: 0}
    for slot, source, nth in plan:
        assert nth == seen[source]
        seen[source] += 1
        for s, share in ((1, 0.5), (2, 0.3), (3, 0.2)):
            assert abs(seen[s] - share * (slot + 1)) < 8


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken_words(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.taken_words(blank).collect()] == [0, 0]


def test_mixture_as_documents(spark):
    rows = [(i, " ".join(["w"] * 50), "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _times", "2 as _same", "3 as size")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["a"] > n["b"] > n["c"] and abs(sum(n.values()) - 90) <= 3
