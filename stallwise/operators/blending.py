"""Content scores and their blend with other scores, cell by cell: user blocks times blocks of the shelf.

A score is the sum over features of a user's taste times an item's value.  Users and units lie in blocks; a unit is an item, or for lists
all items with equal vectors that no other score or purchase knows (they differ by their id alone, so the first of them are enough).
Groups of user blocks and groups of unit blocks meet in cells by an equality key, and a cell scores every pair of its own.
What leaves a cell are ranges per user, the best of every user, or all rows where the whole table is asked for.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import products
from ..functions.products import BLOCK
from ..session import cut_lineage

register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the job

PARTS = ("itemcf", "usercf", "content", "popular")  # in the order in which they are added up
HIDDEN = 2  # kind of a purchase among the rows of a cell; 0 and 1 are itemcf and usercf
USER_BLOCKS, UNIT_BLOCKS, ROWS = 8, 64, 1 << 21  # of a group at most; pairs of a cell whose rows are all wanted
NARROW = 512  # features of a unit block up to which it is multiplied as a full matrix


@dataclass(frozen=True)
class Grid:
    """User blocks (ub, keys, r, f, t), unit blocks (vb, units) and the groups in which they meet."""

    users: products.Axis
    user_blocks: DataFrame
    units: products.Axis
    unit_blocks: DataFrame
    groups: tuple[int, int]
    cells: tuple[int, int]


def grid(taste: DataFrame, vectors: DataFrame, wanted: DataFrame, alone: DataFrame | None = None, popular: DataFrame | None = None,
         keep: int | None = None) -> Grid:
    """Blocks of the ``wanted`` users with their ``taste`` (user_id, feature, t) and of the shelf's ``vectors`` (item_id, feature, v).

    With ``keep`` the items that are not in ``alone`` (item_id) stand together by their vector, and ``keep`` of them are named.
    """
    vectors = cut_lineage(vectors)
    features = products.axis(vectors.select("feature").distinct(), "feature").table.select("feature", F.col("id").alias("f"))
    users = products.axis(wanted, "user_id")
    placed = taste.join(features, "feature").withColumnRenamed("user_id", "_u")
    tastes = placed.join(users.table, F.col("_u").eqNullSafe(F.col("user_id"))).groupBy("block").agg(
        F.collect_list(F.struct(F.col("at").alias("r"), "f", "t")).alias("e"))
    user_blocks = cut_lineage(users.table.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "user_id"))).alias("keys")).join(
        tastes, "block", "left").select(F.col("block").alias("ub"), F.col("keys.user_id").alias("keys"), *[
            F.coalesce(f"e.{c}", F.array().cast(kind)).alias(c) for c, kind in (("r", "array<int>"), ("f", "array<long>"), ("t", "array<double>"))]))

    numbers = products.axis(vectors.select("item_id").distinct(), "item_id").table.select("item_id", "id")
    signed = vectors.join(features, "feature").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vector")).join(
        numbers, "item_id")
    if keep is None:
        units = signed.select(F.col("id").alias("first"), "vector", F.lit(1).cast("long").alias("n"),
                              F.array(F.struct("id", "item_id")).alias("members"), F.lit(1).alias("cold"))
    else:
        signed = signed if alone is None else signed.join(alone.distinct().withColumn("alone", F.lit(True)), "item_id", "left")
        signed = cut_lineage(signed.withColumn("own", F.lit(None).cast("long") if alone is None else F.when(F.col("alone"), F.col("id"))))
        groups = signed.groupBy("vector", "own").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        ranked = signed.withColumn("rank", F.row_number().over(Window.partitionBy("vector", "own").orderBy("id"))).filter(F.col("rank") <= keep)
        members = ranked.groupBy("vector", "own").agg(F.array_sort(F.collect_list(F.struct("id", "item_id"))).alias("members")).select(
            F.col("members")[0]["id"].alias("first"), "members")
        units = groups.join(members, "first").select("first", "vector", "n", "members", F.when(F.col("own").isNull(), 1).otherwise(0).alias("cold"))
    units = cut_lineage(units)
    axis = products.axis(units.select("first", "cold"), "first", near="cold")
    known = units.select("first", F.lit(None).cast("double").alias("popular")) if popular is None else units.select("first").join(
        popular.join(numbers, "item_id").select(F.col("id").alias("first"), F.col("score").alias("popular")), "first", "left")
    unit_blocks = cut_lineage(axis.table.select("first", "block", "at").join(units, "first").join(known, "first").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("at", "vector", "n", "members", "popular"))).alias("units")).withColumnRenamed("block", "vb"))
    counts = [df.count() for df in (user_blocks, unit_blocks)]
    most = (USER_BLOCKS, UNIT_BLOCKS) if keep is not None else (1, ROWS // BLOCK // BLOCK)
    sizes = tuple(max(1, min(top, -(-n // least))) for n, top, least in zip(counts, most, (12, 4)))
    return Grid(users, user_blocks, products.Axis(axis.table.withColumnRenamed("first", "id_of_first").join(
        numbers.withColumnRenamed("id", "id_of_first"), "id_of_first").select("item_id", "id_of_first", "block", "at"), "item_id"),
        unit_blocks, sizes, tuple(max(1, -(-n // s)) for n, s in zip(counts, sizes)))


def placed_rows(g: Grid, rows: DataFrame) -> DataFrame:
    """(ub, vb, r, c, kind, v): rows (user_id, item_id, kind, v) of the grid's users and units that are items of their own, by pairs of blocks."""
    placed = g.units.place(g.users.place(rows, "ub", "_r"), "vb", "_c")
    return placed.groupBy("ub", "vb").agg(F.collect_list(F.struct(
        F.col("_r").alias("r"), F.col("_c").alias("c"), "kind", "v")).alias("e")).select("ub", "vb", *[F.col(f"e.{c}").alias(c) for c in ("r", "c", "kind", "v")])


# ---- inside a task ---------------------------------------------------------------------------
def _array(cell, kind=None):
    import numpy as np

    return np.asarray(cell.values, kind) if cell.is_valid else np.empty(0, kind)


def _unit_block(cell) -> dict:
    """Arrays of a unit block: the postings of its units, sizes, members, popularity."""
    import numpy as np

    units = cell.values
    vectors, members = units.field("vector"), units.field("members")
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = vectors.flatten()
    f, v = np.asarray(flat.field("f")), np.asarray(flat.field("v"))
    features, local = np.unique(f, return_inverse=True)
    out = {"features": features, "size": len(units), "n": np.asarray(units.field("n")), "popular": np.asarray(units.field("popular").fill_null(np.nan), float),
           "member_n": np.asarray(members.value_lengths()).astype(np.int64), "ids": np.asarray(members.flatten().field("id")),
           "items": members.flatten().field("item_id"), "key": features.tobytes()}
    out["member_at"] = np.cumsum(out["member_n"]) - out["member_n"]
    of = np.repeat(np.arange(len(units)), lengths)
    if len(features) <= NARROW:
        out["full"] = np.bincount(local * len(units) + of, weights=v, minlength=len(features) * len(units)).reshape(len(features), len(units))
    else:
        order = np.argsort(-lengths, kind="stable")
        starts = np.cumsum(lengths) - lengths
        out["slots"] = [(order[lengths[order] > s], local[(starts + s)[order[lengths[order] > s]]], v[(starts + s)[order[lengths[order] > s]]])
                        for s in range(int(lengths.max(initial=0)))]
    return out


def _content(user: dict, unit: dict):
    """Scores of a user block and a unit block."""
    import numpy as np

    key, taste = user.get("last", (None, None))
    if key != unit["key"]:
        at = np.searchsorted(unit["features"], user["f"])
        at[at == len(unit["features"])] = 0
        hit = unit["features"][at] == user["f"]
        taste = np.zeros((user["size"], len(unit["features"])))
        taste[user["r"][hit], at[hit]] = user["t"][hit]
        user["last"] = unit["key"], taste
    if "full" in unit:
        return taste @ unit["full"]
    mine, out = np.ascontiguousarray(taste.T), np.zeros((unit["size"], user["size"]))
    for of, feature, value in unit["slots"]:
        out[of] += mine[feature] * value[:, None]
    return np.ascontiguousarray(out.T)


def _met(left, right) -> Iterator:
    """(user block, its unit block, content scores, other rows or None) of a cell."""
    import numpy as np

    units = {vb: _unit_block(cell) for vb, cell in zip(right.column("vb").to_pylist(), right.column("units"))}
    rows, users = {}, []
    for n, (ub, vb) in enumerate(zip(left.column("ub").to_pylist(), left.column("vb").to_pylist())):
        one = {c: _array(left.column(c)[n]) for c in ("r", "c", "kind", "v", "f", "t")}
        if vb is not None:
            rows[ub, vb] = one
        else:
            info = left.column("info")[n]
            keys = left.column("keys")[n].values
            users.append(one | {"ub": ub, "keys": keys, "size": len(keys), "info": np.array(info.as_py()).reshape(len(keys), -1) if info.is_valid else None})
    for user in users:
        for vb in sorted(units):
            yield user, units[vb], _content(user, units[vb]), rows.get((user["ub"], vb))


def _parts(user, unit, rows):
    """Where a unit may be seen, and the other scores with where they stand; None where there are none."""
    import numpy as np

    shape = user["size"], unit["size"]
    open_, parts = None, [None, None]
    if rows is not None:
        for kind in (0, 1):
            here = rows["kind"] == kind
            if here.any():
                values = np.full(shape, np.nan)
                values[rows["r"][here], rows["c"][here]] = rows["v"][here]
                parts[kind] = values
        hidden = rows["kind"] == HIDDEN
        if hidden.any():
            open_ = np.ones(shape, bool)
            open_[rows["r"][hidden], rows["c"][hidden]] = False
    return open_, parts


def _range(values, present, n):
    """Members, least and greatest value of every row where ``present``; None means everywhere."""
    import numpy as np

    if present is None:
        return np.full(len(values), float(n.sum())), values.min(axis=1), values.max(axis=1)
    return present @ n.astype(float), np.where(present, values, np.inf).min(axis=1), np.where(present, values, -np.inf).max(axis=1)


def _ranges_of_cell(left, right):
    import numpy as np
    import pyarrow as pa

    held: dict = {}
    for user, unit, scores, rows in _met(left, right):
        if user["ub"] not in held:
            start = np.zeros((user["size"], 1 + 3 * len(PARTS)))
            start[:, 2::3], start[:, 3::3] = np.inf, -np.inf
            held[user["ub"]] = start
        mine = held[user["ub"]]
        open_, (itemcf, usercf) = _parts(user, unit, rows)
        mine[:, 0] += unit["n"].sum() if open_ is None else open_ @ unit["n"].astype(float)
        listed = ~np.isnan(unit["popular"])
        popular = np.broadcast_to(unit["popular"], scores.shape) if listed.any() else None
        for p, (values, there) in enumerate(((itemcf, None), (usercf, None), (scores, scores > 0), (popular, None))):
            if values is None:
                continue
            there = ~np.isnan(values) if there is None else there
            if open_ is not None:
                there = there & open_
            n, low, high = _range(values, None if there.all() else there, unit["n"])
            at = 1 + 3 * p
            mine[:, at] += n
            mine[:, at + 1], mine[:, at + 2] = np.minimum(mine[:, at + 1], low), np.maximum(mine[:, at + 2], high)
    ubs = np.concatenate([np.full(len(m), ub) for ub, m in held.items()]) if held else np.empty(0, np.int64)
    rs = np.concatenate([np.arange(len(m), dtype=np.int32) for m in held.values()]) if held else np.empty(0, np.int32)
    values = np.concatenate([*held.values()]) if held else np.empty((0, 1 + 3 * len(PARTS)))
    return pa.table([pa.array(ubs, pa.int64()), pa.array(rs, pa.int32()), *map(pa.array, values.T)], names=["ub", "r", *RANGES])


RANGES = ["n_all", *[f"{f}_{p}" for p in PARTS for f in ("n", "lo", "hi")]]


def _blend(user, unit, scores, rows, weights):
    """Blended scores of a pair of blocks and where a candidate stands; None means everywhere."""
    import numpy as np

    low, high = user["info"][:, 0::2], user["info"][:, 1::2]
    span = np.where(high > low, high - low, np.inf)
    scaled = lambda values, p: (values - low[:, p, None]) / span[:, p, None] * weights[p]
    open_, parts = _parts(user, unit, rows)
    there = scores > 0
    total = np.zeros((user["size"], 1))
    for p, values in enumerate(parts):
        if values is None:
            total = total + scaled(np.zeros(1), p)
        else:
            there |= ~np.isnan(values)
            total = total + scaled(np.nan_to_num(values, copy=False), p)
    scores -= low[:, 2, None]
    scores /= span[:, 2, None]
    scores *= weights[2]
    scores += total
    listed = ~np.isnan(unit["popular"])
    if listed.any():
        there |= listed
        scores += scaled(np.where(listed, unit["popular"], 0.0), 3)
    else:
        scores += scaled(np.zeros(1), 3)
    if open_ is not None:
        there &= open_
    return scores, None if there.all() else there


def _best_of_cell(pairs, top: int, decimals: int, names):
    """The ``top`` items of every user over (user, unit, scores, there), by score at so many decimals, then by id."""
    import numpy as np
    import pyarrow as pa

    held: dict = {}
    for user, unit, scores, there in pairs:
        if user["ub"] not in held:
            held[user["ub"]] = {"keys": user["keys"], "least": np.full(user["size"], -np.inf), "units": [], "at": 0,
                                "best": tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.float64))}
        x = held[user["ub"]]
        slack = 2 * 10.0 ** -decimals
        stay = scores >= (x["least"] - slack)[:, None]
        if there is not None:
            stay &= there
        if np.count_nonzero(stay) > 4 * top * len(scores) and scores.shape[1] > top:
            reached = np.partition(np.where(stay, scores, -np.inf), scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
            stay &= scores >= (reached - slack)[:, None]
        r, c = np.nonzero(stay)
        first = unit["ids"][unit["member_at"]]
        best = tuple(map(np.concatenate, zip(x["best"], (r, first[c], x["at"] + c, scores[r, c]))))
        x["units"].append(unit)
        x["at"] += unit["size"]
        order, rank = products.first_of_rows(best[0], best[1], best[3], top, decimals)
        x["best"] = tuple(b[order] for b in best)
        last = order[rank == top - 1]
        x["least"][best[0][last]] = np.maximum(x["least"][best[0][last]], best[3][last])
    tables = []
    for x in held.values():
        r, _, at, score = x["best"]
        n = np.concatenate([u["member_n"] for u in x["units"]])[at]
        sizes = np.cumsum([0] + [len(u["ids"]) for u in x["units"]])
        start = np.concatenate([u["member_at"] + s for u, s in zip(x["units"], sizes)])[at]
        of = np.repeat(np.arange(len(r)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of]
        ids = np.concatenate([u["ids"] for u in x["units"]])[place]
        order, _ = products.first_of_rows(r[of], ids, score[of], top, decimals)
        items = pa.chunked_array([u["items"] for u in x["units"]])
        tables.append(pa.table([x["keys"].take(pa.array(r[of][order])), items.take(pa.array(place[order])).combine_chunks(),
                                pa.array(score[of][order])], names=names))
    return pa.concat_tables(tables)


def _all_of_cell(pairs, names):
    import numpy as np
    import pyarrow as pa

    tables = []
    for user, unit, scores, there in pairs:
        r, c = np.nonzero(np.ones(scores.shape, bool) if there is None else there)
        tables.append(pa.table([user["keys"].take(pa.array(r)), unit["items"].take(pa.array(c)), pa.array(scores[r, c])], names=names))
    return pa.concat_tables(tables)


# ---- outside ---------------------------------------------------------------------------------
def _meet(g: Grid, run, schema, info: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """``run`` on every cell: user blocks with their ``info`` (ub, info) and other ``rows`` (``placed_rows``), and unit blocks."""
    (gu, gv), (cu, cv) = g.groups, g.cells
    left = g.user_blocks if info is None else g.user_blocks.join(info, "ub")
    left = left.select(F.expr(f"ub div {gu}").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cv - 1).cast("long"))).alias("b"), "ub",
                       F.lit(None).cast("long").alias("vb"), "keys", "r", F.array().cast("array<int>").alias("c"), F.array().cast("array<int>").alias("kind"),
                       F.array().cast("array<double>").alias("v"), "f", "t", (F.lit(None).cast("array<array<double>>") if info is None else F.col("info")).alias("info"))
    if rows is not None:
        left = left.unionByName(rows.select(F.expr(f"ub div {gu}").alias("a"), F.expr(f"vb div {gv}").alias("b"), "ub", "vb", "r", "c", "kind", "v"),
                                allowMissingColumns=True)
    right = g.unit_blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cu - 1).cast("long"))).alias("a"), F.expr(f"vb div {gv}").alias("b"), "vb", "units")
    sides = [df.repartition(cu * cv, "a", "b").groupBy("a", "b") for df in (left, right)]
    names = schema.fieldNames()

    def cell(mine, others):
        return run(mine, others) if mine.num_rows and others.num_rows else None

    def shaped(mine, others):
        import pyarrow as pa

        out = cell(mine, others)
        return out if out is not None and out.num_columns else pa.table({n: [] for n in names})

    return sides[0].cogroup(sides[1]).applyInArrow(shaped, schema)


def _schema(g: Grid) -> StructType:
    return StructType([StructField("user_id", g.users.table.schema["user_id"].dataType), StructField("item_id", g.units.table.schema["item_id"].dataType),
                       StructField("score", DoubleType())])


def content_table(taste: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, item_id, score) of every user and every item that shares a feature."""
    taste = cut_lineage(taste)
    g = grid(taste, vectors, taste.select("user_id").distinct())

    def run(left, right):
        return _all_of_cell(((u, x, s, None if (s > 0).all() else s > 0) for u, x, s, _ in _met(left, right)), ["user_id", "item_id", "score"])

    return _meet(g, run, _schema(g))


def blended(taste: DataFrame, vectors: DataFrame, wanted: DataFrame, scores: dict[str, DataFrame], popular: DataFrame, bought: DataFrame | None,
            weights: dict[str, float], top: int | None = None) -> DataFrame:
    """(user_id, item_id, score): the weighted sum of all parts, each min-max scaled over the user's candidates.

    Candidates are the items of ``vectors`` (the shelf) that the user has not bought.  One without a score counts as 0, which matters for
    the minimum as soon as fewer candidates are scored than there are.  Rows are the candidates that have a score in any part;
    with ``top`` those that can be among a user's ``top`` at six decimals.
    """
    alone = popular.select("item_id")
    others = [df.select("user_id", "item_id", F.lit(k).alias("kind"), F.col("score").alias("v")) for k, df in enumerate(scores[p] for p in PARTS[:2])]
    if bought is not None:
        others.append(bought.select("user_id", "item_id", F.lit(HIDDEN).alias("kind"), F.lit(0.0).alias("v")))
    for df in others:
        alone = alone.unionByName(df.select("item_id"))
    g = grid(taste, vectors, wanted, alone, popular, top)
    rows = others[0]
    for df in others[1:]:
        rows = rows.unionByName(df)
    rows = cut_lineage(placed_rows(g, rows))

    found = _meet(g, _ranges_of_cell, StructType.fromDDL("ub long, r int, " + ", ".join(f"{c} double" for c in RANGES)), rows=rows).groupBy("ub", "r").agg(
        *[(F.min if c.startswith("lo_") else F.max if c.startswith("hi_") else F.sum)(c).alias(c) for c in RANGES])
    ends = []
    for p in PARTS:
        whole = F.col(f"n_{p}") >= F.col("n_all")
        lo, hi = (F.when(F.col(f"n_{p}") > 0, F.col(f"{x}_{p}")) for x in ("lo", "hi"))
        low = F.when(whole, F.coalesce(lo, F.lit(0.0))).otherwise(F.lit(0.0) if p == "popular" else F.least(F.coalesce(lo, F.lit(0.0)), F.lit(0.0)))
        high = F.coalesce(hi, F.lit(0.0)) if p == "popular" else F.greatest(F.coalesce(hi, F.lit(0.0)), F.when(whole, hi).otherwise(F.lit(0.0)))
        ends += [low, high]
    info = cut_lineage(found.select("ub", F.struct("r", F.array(*ends).alias("x")).alias("e")).groupBy("ub").agg(
        F.array_sort(F.collect_list("e")).alias("e")).select("ub", F.col("e.x").alias("info")))
    shares = [float(weights.get(p, 0.0)) for p in PARTS]
    names = ["user_id", "item_id", "score"]

    def run(left, right):
        pairs = ((u, x, *_blend(u, x, s, more, shares)) for u, x, s, more in _met(left, right))
        return _all_of_cell(pairs, names) if top is None else _best_of_cell(pairs, top, 6, names)

    return _meet(g, run, _schema(g), info, rows)


def content_best(taste: DataFrame, vectors: DataFrame, bought: DataFrame | None, top: int) -> DataFrame:
    """(user_id, item_id, score): of ``content_table`` the rows that can be among a user's ``top`` not yet bought, at six decimals."""
    taste = cut_lineage(taste)
    g = grid(taste, vectors, taste.select("user_id").distinct(), None if bought is None else bought.select("item_id"), None, top)
    rows = None if bought is None else cut_lineage(placed_rows(g, bought.select(
        "user_id", "item_id", F.lit(HIDDEN).alias("kind"), F.lit(0.0).alias("v"))))

    def seen(user, unit, scores, more):
        there, (open_, _) = scores > 0, _parts(user, unit, more)
        if open_ is not None:
            there &= open_
        return user, unit, scores, None if there.all() else there

    def run(left, right):
        return _best_of_cell((seen(*x) for x in _met(left, right)), top, 6, ["user_id", "item_id", "score"])

    return _meet(g, run, _schema(g), rows=rows)
