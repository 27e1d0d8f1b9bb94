import random

import pytest
import xxhash

from stallwise.llm import simhash
from stallwise.llm.common import components


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_by_the_definition():
    text = "The  Cat\tsat\x0bon THE mat\nÄrger the cat sat"
    words = "the cat sat on the mat Ärger the cat sat".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_bytes(text) == want
    assert simhash.fingerprint_bytes("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint_bytes(" \n") == simhash.fingerprint_bytes(None) == 0


def test_links_connect_what_brute_force_connects(spark):
    dice = random.Random(5)
    prints = set()
    for _ in range(12):  # clumps, many of whose members share a masked segment
        base = dice.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(dice.randrange(4)):
                x ^= 1 << dice.randrange(64)
            prints.add(x)
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    edges = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))
    got = [(r.a, r.b) for r in edges.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    assert groups(prints, got) == groups(prints, pairs)
    assert len(got) < 66 * len(prints)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(300, 299), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e} - {5} | {5}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "y"), (4, "a b c", None), (4, "a b c", None), (9, "A B c", "z"), (None, "a b c", "z"),
            (10, long, "z"), (11, long + " end", "z"), (None, "quite another text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 as component_id", "2 as k")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = {(r.doc_id, r.component_id) for r in got.collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (9, 4), (None, 4), (10, 10), (None, None)} <= found
    assert got.count() == len(rows)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = sorted([-1 if r.doc_id is None else r.doc_id for r in kept.collect()])
    assert ids in ([-1, 1, 4, 10], [-1, 1, 4, 10, 11])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("flips", [0, 1, 2])
def test_a_segment_variant_is_shared_up_to_two_bits(spark, flips):
    a, b = 0x0123456789ABCDEF, 0x0123456789ABCDEF ^ (1 << 3 if flips else 0) ^ (1 << 40 if flips == 2 else 0)
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(a,), (b,)], "fp long").select(simhash.wildcard_keys(F.col("fp")).alias("k")).collect()
    assert set(rows[0].k) & set(rows[1].k)
