"""Near copies among embeddings: binary codes of a random rotation estimate cosines, bounds choose what is computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, cut_lineage

ROWS = 64  # vectors compared with a whole block at a time


@dataclass(frozen=True)
class VectorSettings:
    """Vectors are linked from a cosine of ``similarity`` on.

    ``cell``: distinct vectors that a table's cell holds on average, and at most about so many in a block of one.
    ``miss``: probability that a pair just at the threshold meets in no table; closer pairs are missed less often.
    ``deviations``: standard errors of an estimate within which a pair is computed exactly.
    """

    similarity: float = 0.95
    cell: int = 2048
    miss: float = 0.001
    deviations: float = 5.0
    seed: int = 42

    def tables(self, nodes: int) -> tuple[int, int]:
        """(bits of a key, number of tables) for so many distinct vectors: more bits keep the cells at their size, and more
        tables keep the probability of a miss.  A single cell misses nothing."""
        bits = max(0, math.ceil(math.log2(max(nodes, 1) / self.cell)))
        if not bits:
            return 0, 1
        meet = (1 - math.acos(self.similarity) / math.pi) ** bits
        return bits, math.ceil(math.log(self.miss) / math.log(1 - meet))


def rotated(units, width: int, seed: int):
    """Rows turned by three rounds of random signs and a Hadamard transform, after zeros up to ``width`` (a power of two).

    Only additions in a fixed order, so every machine gets the same bits.
    """
    import numpy as np

    signs = np.random.default_rng(seed).integers(0, 2, (3, width)) * 2.0 - 1
    out = np.zeros((len(units), width))
    out[:, :units.shape[1]] = units
    for round_signs in signs:
        out *= round_signs
        step = 1
        while step < width:
            halves = out.reshape(len(out), -1, 2, step)
            out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(out), width)
            step *= 2
        out /= math.sqrt(width)
    return out


def unit_rows(lists, dim: int):
    """An Arrow column of number lists as unit vectors in doubles; shorter ones end in zeros."""
    import numpy as np

    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    grid = np.zeros((len(lists), dim))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    grid[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    if len(grid):
        grid /= np.abs(grid).max(axis=1, keepdims=True)
        grid /= np.sqrt((grid * grid).sum(axis=1, keepdims=True))
    return grid


def linked_pairs(left, right, table: int, same: bool, settings: VectorSettings):
    """Index pairs (i, j) of two blocks whose cosine reaches the threshold and that met in no earlier table.

    A block is (units, turned, keys).  The code of a vector is the sign of each turned coordinate; its correction factor is
    the product of the code and the vector itself.  Code times the other vector, divided by the factor, estimates the cosine
    without bias.  The estimate's error comes from the part of the other vector across this one, so for a pair at
    the threshold its standard error is known, and only estimates within reach of it are computed in full.
    """
    import numpy as np

    units, turned, keys = left
    other_units, other_turned, other_keys = right
    width = turned.shape[1]
    codes = np.where(turned > 0, 1, -1).astype(np.float32)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(width)
    error = np.sqrt(np.maximum(1 - factor * factor, 0) / max(width - 1, 1)) / factor * math.sqrt(1 - settings.similarity ** 2)
    least = settings.similarity - settings.deviations * error - 1e-4
    # estimate >= least, as code times vector >= least times factor
    enough = (least * factor * math.sqrt(width)).astype(np.float32)[:, None]
    other_turned = other_turned.T.astype(np.float32)
    found = []
    for s in range(0, len(units), ROWS):
        i, j = np.nonzero(codes[s:s + ROWS] @ other_turned >= enough[s:s + ROWS])
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        if table:
            early = (keys[i, :table] == other_keys[j, :table]).any(axis=1)
            i, j = i[~early], j[~early]
        good = np.einsum("ij,ij->i", units[i], other_units[j]) >= settings.similarity
        found.append((i[good], j[good]))
    return tuple(np.concatenate(side) for side in zip(*found))


def smallest_reachable(a, b, size: int):
    """For 0..size-1 the smallest number that can be reached over the edges (a, b)."""
    import numpy as np

    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def links(nodes: DataFrame, dim: int, count: int, settings: VectorSettings = VectorSettings()) -> DataFrame:
    """(a, b, n) of (node, copies, v): vectors ``a`` with ``n`` rows linked to them, and an edge to ``b`` of the same component.

    A table cuts the nodes into cells by some bits of the code, as many as keep the average cell at ``settings.cell``.  A cell
    that is fuller is dealt over blocks, and every two blocks of a cell meet by an equality key.  What leaves a meeting is
    one row per linked vector, never a row per pair.  A pair counts in the first of the tables in which it meets.
    """
    bits, tables = settings.tables(count)
    width = 1 << max(0, math.ceil(math.log2(max(dim, bits * tables, 1))))
    seed, per_cell = settings.seed, settings.cell

    def keys_of(turned):
        import numpy as np

        if not bits:
            return np.zeros((len(turned), 1), np.int64)
        signs = (turned[:, :bits * tables] > 0).reshape(len(turned), tables, bits)
        return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                found = keys_of(rotated(unit_rows(batch.column(2), dim), width, seed))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.int64()))],
                                                 names=["node", "copies", "v", "keys"])

    arrow_rows(nodes.sparkSession, 1024)
    kind = nodes.schema["v"].dataType.simpleString()
    coded = cut_lineage(nodes.select("node", "copies", "v").mapInArrow(keyed, f"node long, copies long, v {kind}, keys array<long>"))
    place = F.posexplode("keys").alias("t", "cell")
    full = cut_lineage(coded.select(place).groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_cell)
                       .select("t", "cell", F.ceil(F.col("n") / per_cell).cast("int").alias("blocks")))
    rows = coded.select("node", "copies", "v", place).join(full, ["t", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))

    def packed(key, table):
        import numpy as np
        import pyarrow as pa

        t, cell, blocks, block = (k.as_py() for k in key)
        grid = unit_rows(table.column("v").combine_chunks(), dim)
        ids, copies = (np.asarray(table.column(c), dtype=np.int64).tobytes() for c in ("node", "copies"))
        return pa.table({"t": [t], "cell": [cell], "blocks": [blocks], "block": [block],
                         "ids": [ids], "copies": [copies], "units": [grid.tobytes()]})

    blocks = cut_lineage(rows.groupBy("t", "cell", "blocks", "block").applyInArrow(
        packed, "t long, cell long, blocks long, block long, ids binary, copies binary, units binary"))
    sent = ("ids", "copies", "units")
    alone = blocks.select("t", F.lit(True).alias("same"), *sent, *[F.lit(None).cast("binary").alias(f"{c}_r") for c in sent])
    crowd = blocks.where("blocks > 1")  # a full cell's blocks meet each other, too
    first = crowd.where("block < blocks - 1").withColumn("to", F.explode(F.expr("sequence(block + 1, blocks - 1)")))
    second = crowd.select("t", "cell", F.col("block").alias("to"), *[F.col(c).alias(f"{c}_r") for c in sent])
    meetings = alone.unionByName(first.join(second, ["t", "cell", "to"]).select("t", F.lit(False).alias("same"), *sent, *[f"{c}_r" for c in sent]))

    def compared(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                t, same, *raw = (c[r].as_py() for c in batch.columns)
                ids, copies, sides = [], [], []
                for at in (0,) if same else (0, 3):
                    ids.append(np.frombuffer(raw[at], np.int64))
                    copies.append(np.frombuffer(raw[at + 1], np.int64))
                    units = np.frombuffer(raw[at + 2], np.float64).reshape(-1, dim)
                    turned = rotated(units, width, seed)
                    sides.append((units, turned, keys_of(turned)))
                i, j = linked_pairs(sides[0], sides[-1], t, same, settings)
                if not len(i):
                    continue
                if not same:
                    ids, copies, j = [np.concatenate(ids)], [np.concatenate(copies)], j + len(sides[0][0])
                n = np.zeros(len(ids[0]), np.int64)
                np.add.at(n, i, copies[0][j])
                np.add.at(n, j, copies[0][i])
                least, linked = smallest_reachable(i, j, len(n)), np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][linked]), pa.array(ids[0][least[linked]]), pa.array(n[linked])],
                                                 names=["a", "b", "n"])

    arrow_rows(nodes.sparkSession, 4)
    return cut_lineage(meetings.mapInArrow(compared, "a long, b long, n long"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    settings: VectorSettings = VectorSettings()) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links``, ``component_id``, ``kept``.

    ``n_links``: other rows whose vector has a cosine of at least ``settings.similarity`` with this one.  ``component_id``: the
    smallest key that can be reached over links.  ``kept``: the row with that key.

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing and are kept.  Of vectors of
    different lengths the shorter one ends in zeros.  Equal vectors and repeated rows are rows of their own that link with
    each other; they travel as one vector with a number of copies.  Rows without a key link like any other; their component is
    null only if none of its rows has a key, and they are kept only then.  An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    v = F.col("v")
    usable = v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    element = vectors.schema[vector].dataType.elementType.simpleString()
    number = vectors.select(F.col(key).alias("vec_id"),
                            F.col(vector).cast(f"array<{'float' if element == 'float' else 'double'}>").alias("v"))
    rows = number.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn(
        "h2", F.xxhash64(F.lit(settings.seed), "v"))
    nodes = cut_lineage(rows.where("usable").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()))
    count, dim = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    found = links(nodes, dim or 1, count, settings)
    linked = found.groupBy("a").agg(F.sum("n").alias("n"))
    placed = nodes.join(components(found.select("a", "b")).withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left").withColumn(
        "group", F.coalesce("component", "node"))
    smallest = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    named = placed.select("h1", "h2", "node", "group", "copies").join(smallest, "group").join(
        linked, F.col("node") == F.col("a"), "left").select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.lit(True).alias("is_node"))
    out = rows.select("vec_id", "usable", "h1", "h2").join(
        named, F.col("usable") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.when(F.col("is_node"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(F.col("vec_id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
