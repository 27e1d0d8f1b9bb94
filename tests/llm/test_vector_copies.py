import math

import numpy as np
import pytest

from stallwise.llm.vector_copies import VectorSettings, linked_pairs, near_duplicates, rotated


def brute(units, similarity=0.95):
    """n_links and component (as the smallest row number) of unit rows, by all pairs in doubles."""
    linked = units @ units.T >= similarity
    np.fill_diagonal(linked, False)
    label = np.arange(len(units))
    while True:
        after = np.array([min(label[i], label[linked[i]].min(initial=len(units))) for i in range(len(units))])
        if (after == label).all():
            return linked.sum(axis=1), label
        label = after


def crowds(seed, sizes, dim, noise):
    dice = np.random.default_rng(seed)
    rows = np.concatenate([dice.normal(size=dim) + noise * dice.normal(size=(n, dim)) for n in sizes])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"vec_id long, embedding array<{kind}>")


def test_rotation_keeps_lengths_and_angles():
    units = crowds(1, [30], 24, 1.0)
    turned = rotated(units, 64, 7)
    assert np.allclose(turned @ turned.T, units @ units.T)


def test_estimates_are_unbiased_and_within_their_error():
    units = crowds(2, [1, 1], 64, 1.0)
    units[1] = 0.95 * units[0] + math.sqrt(1 - 0.95 ** 2) * (units[1] - (units[1] @ units[0]) * units[0]) / np.linalg.norm(
        units[1] - (units[1] @ units[0]) * units[0])
    estimates = []
    for seed in range(400):
        a, b = rotated(units, 64, seed)
        factor = np.abs(a).sum() / 8
        estimates.append((np.where(a > 0, 1, -1) @ b) / 8 / factor)
    assert abs(np.mean(estimates) - 0.95) < 0.005
    assert 0.95 - min(estimates) < 5 * 0.75 / math.sqrt(63) * math.sqrt(1 - 0.95 ** 2)


def test_pairs_of_a_block_are_those_of_brute_force():
    units = crowds(3, [90, 5, 1, 1, 1], 32, 0.22)
    turned = rotated(units, 32, 1)
    side = (units, turned, np.zeros((len(units), 1), np.int64))
    i, j = linked_pairs(side, side, 0, True, VectorSettings())
    a, b = np.nonzero(np.triu(units @ units.T >= 0.95, 1))
    assert sorted(zip(i, j)) == sorted(zip(a, b)) and 0 < len(i) < 90 * 89 / 2


@pytest.mark.parametrize("cell, least", [(2048, 1.0), (32, 0.99)])
def test_links_and_components_against_all_pairs(spark, cell, least):
    """One cell finds all; many small tables, whose cells a crowd of 150 overfills, find at least 0.99."""
    units = crowds(4, [150, 40, 7, 2, *[1] * 60], 32, 0.2)
    units = np.concatenate([units, units[:3], 2 * units[5:6]])
    n, component = brute(units / np.linalg.norm(units, axis=1, keepdims=True))
    got = near_duplicates(frame(spark, units), settings=VectorSettings(cell=cell)).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(len(units)))
    found = np.array([r.n_links for r in got])
    assert (found <= n).all() and found.sum() >= least * n.sum()
    assert np.mean([r.component_id == c for r, c in zip(got, component)]) >= least
    assert all(r.kept == (r.component_id == r.vec_id) for r in got)


def test_recall_at_the_threshold(spark):
    """Pairs a hair above 0.95 in 25 tables of 11 bits."""
    dice = np.random.default_rng(9)
    rows = []
    for _ in range(400):
        a, b = dice.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        rows += [a, 0.951 * a + math.sqrt(1 - 0.951 ** 2) * b / np.linalg.norm(b)]
    cfg = VectorSettings(cell=1)
    assert cfg.tables(800)[0] == 10
    got = near_duplicates(frame(spark, rows), settings=cfg).agg({"n_links": "sum"}).first()[0]
    assert got >= 0.99 * 800


def test_odd_vectors_and_repeated_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [5e30]),
            (9, [1e-40, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 2.0]), (None, [0.0, 1.0]), (None, None), (12, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = near_duplicates(spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, n long, NODE string"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(i, 0, i, True) for i in range(1, 7)] + [(7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (9, 3, 7, False),
         (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (12, 1, 12, True), (None, 1, 12, False)], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
