import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from stallwise.llm.trie import TrieSettings, nodes, prefix_trie, rebuilt, sequences


def conversations(rows):
    """conv_id -> turns (role, text) in order, of rows with turns that have no ties."""
    out = defaultdict(list)
    for c, n, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        out[c].append((role or "", text or ""))
    return out


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(path))
        out.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), len(children), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs=60):
    dice = random.Random(seed)
    rows = []
    for c in range(convs):
        start = dice.choice([[], ["hello", "hi there"], ["hello", "hi there", "ähm", None]])
        turns = start + [dice.choice(["yes", "no", "", "long text " * 9]) for _ in range(dice.randrange(12))]
        rows += [(c * 3, i if i else None, dice.choice(["user", None]) if i > 3 else "user", t) for i, t in enumerate(turns)]
    rows += [(1000 + c, i, "user", "copy %d" % i) for c in range(40) for i in range(15)]  # a group of copies
    rows += [(2000 + c, i, "user", "chain") for c in range(25) for i in range(c + 1)]  # each the start of the next
    dice.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "conv_id long, turn long, role string, text string, IDS long, sizes string").repartition(3)


@pytest.mark.parametrize("container", [100_000, 40, 1])
def test_nodes_of_rebuilt_conversations(spark, container):
    rows = made(1)
    got = nodes(rebuilt(sequences(frame(spark, rows))), TrieSettings(container)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rebuild(conversations(rows)))


def test_nodes_of_conversations_as_they_are(spark):
    rows = made(2, 20) + [(None, 1, "user", "left out"), (-7, 1, None, None), (-7, 2, "a", "bc"), (-8, 1, None, None), (-8, 2, "ab", "c")]
    got = prefix_trie(frame(spark, rows), settings=TrieSettings(30)).collect()
    assert sorted(map(tuple, got), key=str) == brute(conversations(rows))


def test_repeated_rows_are_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = sorted(tuple(r)[:7] for r in prefix_trie(frame(spark, rows)).collect())
    assert got == [(1, 0, None, 2, 1, 1, 1), (1, 1, 1, 2, 1, 1, 1), (1, 2, 1, 1, 0, 1, 0)]


def test_a_conversation_may_lose_all_its_turns(spark):
    # crc32("3") % 9 takes no more than the base has, and the base has none
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 5)}
    c = max(h, key=h.get)
    got = nodes(rebuilt(sequences(frame(spark, [(c, i, "user", "x") for i in range(h[c])])))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table(spark):
    assert prefix_trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0
