"""Sparse products by blocks: row blocks times column blocks, partial products summed per block.

A table of (row, column, value) becomes packed blocks; blocks that share their middle axis meet by an equality key, and a task
adds up what it makes of the same result block before anything is shuffled.  A result never exists as one row per pair unless it
is asked for: it is read off the summed blocks as rows, as the best of every row, or as blocks for the next product.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut_lineage
from .sequence import even_buckets, running_total

register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the job

BLOCK = 512  # positions of an axis in a block: a block holds at most 512 x 512 values, whatever is hot
HELD = 32  # result blocks of 2 MB that a task adds up at a time
DENSE = 2_000  # products for each shared middle position from which a pair of blocks is multiplied as full matrices
BATCH = 16  # blocks that go to a task at a time
GROUP = 16  # row blocks of a group; groups meet in cells
GROUPS = 12  # groups at least, as far as there are blocks
HEAVY = 1 << 21  # values of a group, where a block does not hold more
COMMON = 64  # rows of a piece that share a column from which the column is multiplied as a full one


@dataclass(frozen=True)
class Axis:
    """Keys of one axis: (key, id, block, at).  ``id`` counts in the order of the keys and decides ties."""

    table: DataFrame
    key: str

    def place(self, df: DataFrame, block: str, at: str, key: str | None = None) -> DataFrame:
        """``df`` with the place of its ``key``; other keys leave."""
        key = key or self.key
        return df.join(self.table.select(F.col(self.key).alias(key), F.col("block").alias(block), F.col("at").alias(at)), key)

    def arrays(self, values: DataFrame, value: str, kind: str) -> DataFrame:
        """(block, ``value``): an array of every block by position; ``values`` has one row per key."""
        placed = values.select(self.key, F.col(value).cast(kind).alias("x")).join(self.table.select(self.key, "block", "at"), self.key)
        return placed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(value))

    def ids(self) -> DataFrame:
        return self.arrays(self.table, "id", "long").withColumnRenamed("id", "ids")


def axis(keys: DataFrame, key: str, near: str | None = None) -> Axis:
    """An axis of the distinct keys of ``keys``; those with the same ``near`` are placed side by side.

    Numbers come from sampled ranges and per-range counts, so no task sees all keys.
    """
    table = keys.select(key, *([near] if near else [])).withColumn("one", F.lit(1))

    def counted(df: DataFrame, order: list[str], out: str) -> DataFrame:
        return running_total(even_buckets(df, order, "_range"), "_range", order, ["one"]).withColumn(out, F.col("cum_one") - 1).drop(
            "cum_one", "_range")

    table = counted(table, [key], "id")
    table = counted(table, [near, "id"], "place") if near else table.withColumn("place", F.col("id"))
    return Axis(cut_lineage(table.select(
        key, "id", F.expr(f"place div {BLOCK}").alias("block"), F.expr(f"cast(place % {BLOCK} as int)").alias("at"))), key)


def packed(df: DataFrame, rows: Axis, columns: Axis, value: str, row: str | None = None, column: str | None = None) -> DataFrame:
    """(i, k, at, v): the values of ``df`` by row block and column block, at position row x BLOCK + column."""
    placed = columns.place(rows.place(df, "i", "_r", row), "k", "_c", column)
    one = F.struct((F.col("_r") * BLOCK + F.col("_c")).alias("at"), F.col(value).cast("double").alias("v"))
    return placed.groupBy("i", "k").agg(F.collect_list(one).alias("e")).select("i", "k", F.col("e.at").alias("at"), F.col("e.v").alias("v"))


def turned(blocks: DataFrame) -> DataFrame:
    """The transpose of packed blocks."""
    return blocks.select(F.col("k").alias("i"), F.col("i").alias("k"),
                         F.transform("at", lambda x: (x % BLOCK) * BLOCK + F.floor(x / BLOCK).cast("int")).alias("at"), "v")


@contextmanager
def block_batches(spark: SparkSession):
    """Few rows in an Arrow batch while blocks are sent; the session's own setting afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def add_product(total, a_at, a_v, b_at, b_v) -> None:
    """Add the product of two packed blocks to the matrix ``total``: full matrices where that is cheaper, else value by value."""
    import numpy as np

    a_row, a_col, b_row, b_col = a_at // BLOCK, a_at % BLOCK, b_at // BLOCK, b_at % BLOCK
    per_row = np.bincount(b_row, minlength=BLOCK)
    meets = per_row[a_col]
    shared = (np.bincount(a_col, minlength=BLOCK) > 0) & (per_row > 0)
    if int(meets.sum()) > DENSE * int(np.count_nonzero(shared)):
        left, right = np.zeros((2, BLOCK, BLOCK))
        left[a_row, a_col], right[b_row, b_col] = a_v, b_v
        total += left[:, shared] @ right[shared]
        return
    order = np.argsort(b_row, kind="stable")
    b_col, b_v = b_col[order], b_v[order]
    start = np.cumsum(per_row) - per_row
    of_a = np.repeat(np.arange(len(a_col)), meets)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(meets) - meets, meets) + start[a_col][of_a]
    total += np.bincount(a_row[of_a] * BLOCK + b_col[of_b], weights=a_v[of_a] * b_v[of_b], minlength=BLOCK * BLOCK).reshape(BLOCK, BLOCK)


def best_of_rows(total, top: int, ids, skip_same: bool, decimals: int):
    """(row, column) of the ``top`` positive values of every row: by value at so many decimals, then by id."""
    import numpy as np

    rows, columns = np.nonzero(total > 0)
    if skip_same:
        rows, columns = rows[rows != columns], columns[rows != columns]
    order = np.lexsort((ids[columns], -np.round(total[rows, columns], decimals), rows))
    rows, columns = rows[order], columns[order]
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, bool)
    rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return rows[rank < top], columns[rank < top]


def multiply(left: DataFrame, right: DataFrame, top: int | None = None, ids: DataFrame | None = None, hidden: DataFrame | None = None,
             pairs: DataFrame | None = None, skip_same: bool = False, decimals: int = 9, norms: DataFrame | None = None,
             hair: float = 0.0) -> DataFrame:
    """The product of packed blocks (i, k) and (k, j), as packed blocks (i, j under the names i, k).

    ``top``: only the best values of every row of a block, compared at ``decimals``, ties by the ``ids`` (block, ids) of the columns;
    ``skip_same`` leaves out the diagonal of a square product.  ``norms`` (block, norms) of a square product divide every summed
    value by the product of its row's and its column's norm plus ``hair``.  ``hidden`` blocks (i, k, at) name values that are left out.  ``pairs`` (i, j): the only
    result blocks that are made.
    """
    spark = left.sparkSession
    meetings = left.select("i", "k", F.col("at").alias("a_at"), F.col("v").alias("a_v")).join(
        right.select(F.col("i").alias("k"), F.col("k").alias("j"), F.col("at").alias("b_at"), F.col("v").alias("b_v")), "k")
    if pairs is not None:
        meetings = meetings.join(pairs, ["i", "j"], "left_semi")

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[tuple[int, int], np.ndarray] = {}

        def released() -> Iterator:
            for (i, j), total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([j]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([total.ravel()[at]], pa.list_(pa.float64()))],
                    names=["i", "j", "at", "v"])
            held.clear()

        for batch in batches:
            i, j, *sides = batch.columns
            for n in range(batch.num_rows):
                where = i[n].as_py(), j[n].as_py()
                if where not in held:
                    if len(held) == HELD:
                        yield from released()
                    held[where] = np.zeros((BLOCK, BLOCK))
                add_product(held[where], *(np.asarray(side[n].values) for side in sides))
        yield from released()

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        where, total, order, divisors = None, None, None, None

        def whole_block(array, kind):
            out = np.ones(BLOCK, kind)
            out[:len(array.values)] = np.asarray(array.values)
            return out

        def finished():
            if divisors:
                np.divide(total, np.outer(*divisors) + hair, out=total)
            if top is None:
                at = np.flatnonzero(total)
                at = at[total.ravel()[at] != -np.inf]
            else:
                rows, columns = best_of_rows(total, top, order, skip_same and where[0] == where[1], decimals)
                at = rows * BLOCK + columns
            return pa.RecordBatch.from_arrays(
                [pa.array([where[0]]), pa.array([where[1]]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([total.ravel()[at]], pa.list_(pa.float64()))], names=["i", "k", "at", "v"])

        for batch in batches:
            i, j, at, v, block_ids, *sides = batch.columns
            for n in range(batch.num_rows):
                here = i[n].as_py(), j[n].as_py()
                if here != where:
                    if where:
                        yield finished()
                    where, total = here, np.zeros((BLOCK, BLOCK))
                    order = whole_block(block_ids[n], np.int64) if block_ids[n].is_valid else np.arange(BLOCK)
                    divisors = [whole_block(side[n], np.float64) for side in sides]
                total.ravel()[np.asarray(at[n].values)] += np.asarray(v[n].values)
        if where:
            yield finished()

    kind = "at array<int>, v array<double>"
    with block_batches(spark):
        parts = cut_lineage(meetings.select("i", "j", "a_at", "a_v", "b_at", "b_v").mapInArrow(partial, f"i long, j long, {kind}"))
        if hidden is not None:
            parts = parts.unionByName(hidden.select("i", F.col("k").alias("j"), "at", F.transform(
                "at", lambda x: F.lit(float("-inf"))).alias("v")).join(parts.select("i", "j").distinct(), ["i", "j"], "left_semi"))
        if ids is not None:
            parts = parts.join(ids.withColumnRenamed("block", "j"), "j")
        else:
            parts = parts.withColumn("ids", F.lit(None).cast("array<long>"))
        sides = []
        if norms is not None:
            for side in "ij":
                parts = parts.join(norms.select(F.col("block").alias(side), F.col("norms").alias(f"norm_{side}")), side)
                sides.append(f"norm_{side}")
        return cut_lineage(parts.select("i", "j", "at", "v", "ids", *sides).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(
            summed, f"i long, k long, {kind}"))


def _own_columns(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it may meet a frame made from the same table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def whole_rows(df: DataFrame, rows: Axis, columns: Axis, value: str) -> DataFrame:
    """(i, r, c, v): a row block with all its values, by position in the block and by place on the column axis."""
    placed = columns.place(rows.place(df, "i", "_r"), "_k", "_c")
    one = F.struct(F.col("_r").alias("r"), (F.col("_k") * BLOCK + F.col("_c")).alias("c"), F.col(value).cast("double").alias("v"))
    return placed.groupBy("i").agg(F.collect_list(one).alias("e")).select(
        "i", F.col("e.r").alias("r"), F.col("e.c").alias("c"), F.col("e.v").alias("v"))


def group_size(blocks: DataFrame) -> int:
    """Row blocks that make a group: bounded by number and by values, and few enough to have some groups."""
    seen = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)).alias("values")).first()
    return max(1, min(GROUP, -(-seen["n"] // GROUPS), HEAVY * seen["n"] // max(seen["values"], 1)))


def _added(total, rows, piece) -> None:
    """Add the product of a row block (r, c, v) and a ``piece`` of rows to ``total``: common columns as matrices, the others value by value."""
    import numpy as np

    r, c, v = rows
    common, full, (b_c, b_r, b_v), width = piece
    at = np.searchsorted(common, c)
    at[at == len(common)] = 0
    hit = common[at] == c if len(common) else np.zeros(len(c), bool)
    for low in range(0, len(common), 1024):
        mine = hit & (at >= low) & (at < low + 1024)
        if mine.any():
            right = full(low)
            left = np.zeros((BLOCK, right.shape[0]))
            left[r[mine], at[mine] - low] = v[mine]
            total += left @ right
    r, c, v = r[~hit], c[~hit], v[~hit]
    start = np.searchsorted(b_c, c)
    meets = np.searchsorted(b_c, c, side="right") - start
    r, c, v, start, meets = (x[meets > 0] for x in (r, c, v, start, meets))
    for low in range(0, len(r), 1 << 14):
        some = slice(low, low + (1 << 14))
        n = meets[some]
        of_a = np.repeat(np.arange(len(n)), n)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n, n) + start[some][of_a]
        total += np.bincount(r[some][of_a] * width + b_r[of_b], weights=v[some][of_a] * b_v[of_b], minlength=BLOCK * width).reshape(BLOCK, width)


def _piece(blocks):
    """What ``_added`` takes of some row blocks (r, c, v) side by side."""
    import numpy as np

    r = np.concatenate([n * BLOCK + b[0] for n, b in enumerate(blocks)])
    c, v = (np.concatenate([b[x] for b in blocks]) for x in (1, 2))
    width = len(blocks) * BLOCK
    columns, of, counts = np.unique(c, return_inverse=True, return_counts=True)
    common = columns[counts >= COMMON]
    rare = counts[of] < COMMON
    at = np.searchsorted(common, c[~rare])
    common_r, common_v = r[~rare], v[~rare]
    kept = {}

    def full(low):
        if low not in kept:
            if len(kept) == 2:  # 16 MB each
                kept.clear()
            here = (at >= low) & (at < low + 1024)
            kept[low] = np.zeros((min(1024, len(common) - low), width))
            kept[low][at[here] - low, common_r[here]] = common_v[here]
        return kept[low]

    order = np.argsort(c[rare], kind="stable")
    return common, full, (c[rare][order], r[rare][order], v[rare][order]), width


def first_of_rows(rows, ids, values, top: int, decimals: int):
    """Order and rank of the ``top`` entries of every row: by value at so many decimals, then by id."""
    import numpy as np

    order = np.lexsort((ids, -np.round(values, decimals), rows))
    rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    return order[rank < top], rank[rank < top]


def nearest_rows(blocks: DataFrame, about: DataFrame, pairs: DataFrame, top: int, group: int, bounds: DataFrame | None = None,
                 hair: float = 0.0, decimals: int = 9) -> DataFrame:
    """(i, row, place, id, sim, bound): for every row block and cell the ``top`` most similar other rows of its rows, as arrays.

    ``blocks`` (i, r, c, v) are whole row blocks, ``about`` (block, ids, norms), ``pairs`` (i, j) the blocks that meet.  A similarity is
    the product of two rows over the product of their norms plus ``hair``.  Groups of blocks meet in cells, so a block is copied once
    for every group it meets; a cell keeps only the best of every row while it goes through the pairs.  ``bounds`` (i, bound): a
    similarity of every row that ``top`` others reach already; ``bound`` is the same for these rows, 0 where there are fewer.
    """
    meets = pairs.withColumns({"g": F.expr(f"i div {group}"), "h": F.expr(f"j div {group}")})
    cells = max(meets.select("g", "h").distinct().count(), 1)
    left = blocks.join(meets.groupBy("g", "h", "i").agg(F.collect_list("j").alias("js")), "i").join(
        about.select(F.col("block").alias("i"), "norms"), "i")
    left = left.withColumn("bound", F.array().cast("array<double>")) if bounds is None else left.join(bounds, "i")
    right = blocks.withColumnRenamed("i", "j").join(meets.select("g", "h", "j").distinct(), "j").join(about.withColumnRenamed("block", "j"), "j")

    def met(mine, others):
        import numpy as np
        import pyarrow as pa

        def values(table, n, *names):
            return tuple(np.asarray(table.column(x)[n].values) for x in names)

        def whole(array, fill=0.0):
            out = np.full(BLOCK, fill, array.dtype)
            out[:len(array)] = array
            return out

        js = {j: n for n, j in enumerate(others.column("j").to_pylist())}
        rows = []
        for n, i in enumerate(mine.column("i").to_pylist()):
            norms, bound, wanted = values(mine, n, "norms", "bound", "js")
            rows.append({"i": i, "rows": values(mine, n, "r", "c", "v"), "norms": whole(norms, 1), "least": whole(bound), "js": set(wanted.tolist()),
                         "best": tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.float64))})
        slack, each = 2 * 10.0 ** -decimals, sorted(js)
        for low in range(0, len(each), 4):
            here = each[low:low + 4]
            piece = _piece([values(others, js[j], "r", "c", "v") for j in here])
            ids = np.concatenate([whole(values(others, js[j], "ids")[0], 1) for j in here])
            norms = np.concatenate([whole(values(others, js[j], "norms")[0], 1) for j in here])
            places = np.concatenate([j * BLOCK + np.arange(BLOCK) for j in here])
            for x in rows:
                if not any(j in x["js"] for j in here):
                    continue
                total = np.zeros((BLOCK, len(places)))
                _added(total, x["rows"], piece)
                for n, j in enumerate(here):
                    part = total[:, n * BLOCK:(n + 1) * BLOCK]
                    if j not in x["js"]:
                        part[:] = 0
                    elif j == x["i"]:
                        np.fill_diagonal(part, 0)
                stay = total >= np.multiply.outer((x["least"] - slack) * x["norms"], norms)
                stay &= total > 0
                if np.count_nonzero(stay) > 4 * top * BLOCK and total.shape[1] > top:
                    sims = total / (np.multiply.outer(x["norms"], norms) + (hair or 1e-300))
                    reached = np.partition(sims, sims.shape[1] - top, axis=1)[:, sims.shape[1] - top]
                    stay &= sims >= (reached - slack)[:, None]
                r, c = np.nonzero(stay)
                if not len(r):
                    continue
                best = tuple(map(np.concatenate, zip(x["best"], (r, places[c], ids[c], total[r, c] / (x["norms"][r] * norms[c] + hair)))))
                order, rank = first_of_rows(best[0], best[2], best[3], top, decimals)
                x["best"] = tuple(b[order] for b in best)
                last = order[rank == top - 1]
                x["least"][best[0][last]] = np.maximum(x["least"][best[0][last]], best[3][last])
        out = [(x["i"], x["best"][0].astype(np.int32), *x["best"][1:], x["least"]) for x in rows]
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds],
                                    names=["i", "row", "place", "id", "sim", "bound"])

    sides = [_own_columns(df).repartition(cells, "g", "h").groupBy("g", "h") for df in (left, right)]
    return cut_lineage(sides[0].cogroup(sides[1]).applyInArrow(
        met, "i long, row array<int>, place array<long>, id array<long>, sim array<double>, bound array<double>"))


def merged_rows(parts: DataFrame, rows: Axis, row: str, column: str, top: int, decimals: int = 9) -> DataFrame:
    """(row, column, sim, rank): the ``top`` of every row over all ``parts`` of ``nearest_rows``, by the axis' keys."""

    def merged(table):
        import numpy as np
        import pyarrow as pa

        at, place, ids, sims = (np.concatenate([np.asarray(x.values) for x in table.column(c)]) for c in ("row", "place", "id", "sim"))
        order, rank = first_of_rows(at, ids, sims, top, decimals)
        return pa.table([pa.array(np.full(len(order), table.column("i")[0].as_py())), pa.array(at[order].astype(np.int32)),
                         pa.array(place[order] // BLOCK), pa.array((place[order] % BLOCK).astype(np.int32)), pa.array(sims[order]),
                         pa.array((rank + 1).astype(np.int32))], names=["i", "_r", "k", "_c", "sim", "rank"])

    flat = parts.groupBy("i").applyInArrow(merged, "i long, _r int, k long, _c int, sim double, rank int")
    for block, at, name in (("i", "_r", row), ("k", "_c", column)):
        flat = flat.join(rows.table.select(F.col("block").alias(block), F.col("at").alias(at), F.col(rows.key).alias(name)), [block, at])
    return flat.select(row, column, "sim", "rank")


def mixed_rows(near: DataFrame, theirs: DataFrame, row: str, other: str, column: str, share: str, value: str, out: str) -> DataFrame:
    """(row, column, out): the rows of ``theirs`` (other, column, value) added up by the shares of ``near`` (row, other, share).

    Some rows at a time meet the distinct others they name, each with all its values; what is added up never stands as rows.
    """
    held = cut_lineage(theirs.filter(F.col(other).isNotNull()).groupBy(other).agg(F.collect_list(F.struct(column, value)).alias("e")).select(
        other, F.col(f"e.{column}").alias("columns"), F.col(f"e.{value}").alias("values")))
    spread = max(1, -(-held.count() // 4096), min(24, held.count() // 256))
    near = cut_lineage(near.select(row, other, share).withColumn("part", F.pmod(F.xxhash64(row), F.lit(spread).cast("long"))))
    kinds = {row: near.schema[row].dataType, column: theirs.schema[column].dataType}

    def mixed(mine, others):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = mine.column(row).combine_chunks()
        names = pc.unique(keys)
        if not others.num_rows or not mine.num_rows:
            return pa.table([names.slice(0, 0), others.column("columns").combine_chunks().flatten().slice(0, 0), pa.array([], pa.float64())], names=[row, column, out])
        lists, values = others.column("columns").combine_chunks(), np.asarray(others.column("values").combine_chunks().flatten())
        labels = pc.unique(lists.flatten())
        label = np.asarray(pc.index_in(lists.flatten(), value_set=labels)).astype(np.int64)
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        at = np.asarray(pc.index_in(keys, value_set=names)).astype(np.int64)
        of = np.asarray(pc.index_in(mine.column(other).combine_chunks(), value_set=others.column(other).combine_chunks()).fill_null(-1)).astype(np.int64)
        shares = np.asarray(mine.column(share).combine_chunks())
        order = np.argsort(at, kind="stable")[of[np.argsort(at, kind="stable")] >= 0]
        at, of, shares = at[order], of[order], shares[order]
        step = max(1, (1 << 22) // len(labels))
        tables = []
        for low in range(0, len(names), step):
            some = slice(*np.searchsorted(at, (low, low + step)))
            n = sizes[of[some]]
            e = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + starts[of[some]][e]
            cell = (at[some][e] - low) * len(labels) + label[place]
            total = np.bincount(cell, weights=shares[some][e] * values[place], minlength=1)
            full = np.flatnonzero(np.bincount(cell, minlength=1))
            tables.append(pa.table([names.take(pa.array(low + full // len(labels))), labels.take(pa.array(full % len(labels))), pa.array(total[full])],
                                   names=[row, column, out]))
        return pa.concat_tables(tables)

    asked = near.select("part", other).distinct().join(held, other)
    sides = [_own_columns(df).repartition(spread, "part").groupBy("part") for df in (near, asked)]
    return sides[0].cogroup(sides[1]).applyInArrow(mixed, StructType([StructField(n, t) for n, t in kinds.items()] + [StructField(out, DoubleType())]))


def unpacked(blocks: DataFrame, rows: Axis, columns: Axis, row: str, column: str, value: str) -> DataFrame:
    """(row, column, value) of packed blocks, by the axes' keys."""
    flat = blocks.select("i", "k", F.explode(F.arrays_zip("at", "v")).alias("e")).select(
        "i", "k", F.expr(f"e.at div {BLOCK}").cast("int").alias("_r"), (F.col("e.at") % BLOCK).alias("_c"), F.col("e.v").alias(value))
    for ax, block, at, name in ((rows, "i", "_r", row), (columns, "k", "_c", column)):
        flat = flat.join(ax.table.select(F.col("block").alias(block), F.col("at").alias(at), F.col(ax.key).alias(name)), [block, at])
    return flat.select(row, column, value)


def reachable_pairs(blocks: DataFrame, heads: DataFrame, rows: Axis, columns: Axis) -> DataFrame:
    """(i, j): row blocks (i, r, c, v) that hold a row one of whose ``heads`` (row key, column key) occurs in row block ``j``.

    ``heads`` are the heaviest columns of every row, as many as leave a rest too light for what is looked for: where none of them
    occurs, nothing is missed.
    """
    asked = columns.place(rows.place(heads, "i", "_r"), "_k", "_c").select("i", (F.col("_k") * BLOCK + F.col("_c")).alias("c")).distinct()
    there = blocks.select(F.col("i").alias("j"), F.explode(F.array_distinct("c")).alias("c"))
    return asked.join(there, "c").select("i", "j").distinct()
