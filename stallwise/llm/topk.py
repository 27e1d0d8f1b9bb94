"""Exact top-k inner products by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage

SCALE = 256
TOP = 5
QUERY_EVERY = 50

BLOCK = 1024  # vectors of a candidate block and of a query block
DIMENSIONS = 16  # dimensions added per step
EXACT = float(1 << 52)  # sums of whole numbers below this are exact in a double
CELL = 1 << 24  # components of the candidates of a cell (2 to 8 bytes each)
ASKED = 1 << 22  # components of the queries of a cell
PIECE = 1 << 20  # components of the candidates that are multiplied at a time
CELLS = 48  # cells at least, as far as there are blocks


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component, in doubles; vectors that take no part are left out."""
    v = F.col("v")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & usable).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


def _packed(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (vec_id, v) in blocks: ids, and the vectors column by column (shorter ones end in zeros)."""

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
            width = int(lengths.max(initial=0))
            flat = np.asarray(lists.flatten(), dtype=np.float64)
            grid = np.zeros((batch.num_rows, width))
            grid[np.repeat(np.arange(batch.num_rows), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            ids = np.asarray(batch.column(0), dtype=np.int64)
            most = np.abs(grid).max(initial=0.0)
            kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "float64"  # whole numbers: the narrowest that holds them
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.num_rows], pa.int32()), pa.array([width], pa.int32()), pa.array([kind], pa.string()),
                pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(grid.T, kind).tobytes()], pa.binary())],
                names=["n", "width", "kind", "ids", "columns"])

    return df.mapInArrow(mapped, "n int, width int, kind string, ids binary, columns binary")


def best_of_cell(cand_ids, cand, query_ids, query, top: int = TOP, step: int = DIMENSIONS, reached=None):
    """Yields (query index, vec_id, score) of each query's best candidates.

    ``cand`` and ``query`` are dimension x vector.  Dimensions are added ``step`` at a time, the widest spread first.
    By Cauchy-Schwarz what is still to come lies within the product of both remaining masses; the k-th best lower
    bound is the threshold, and candidates whose upper bound is below it are compacted away.  Ties survive.
    ``reached``: a score of every query that ``top`` other candidates reach already; it is the threshold from the start.
    """
    import numpy as np

    width = max(cand.shape[0], query.shape[0])
    cand = np.pad(cand, ((0, width - cand.shape[0]), (0, 0)))
    query = np.pad(query, ((0, width - query.shape[0]), (0, 0)))
    bound = np.abs(cand).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(width, 1)
    if bound >= EXACT:  # beyond doubles: whole numbers of any size, without bounds
        wide_c = [[int(x) for x in col] for col in cand.T]
        for q in range(query.shape[1]):
            qv = [int(x) for x in query[:, q]]
            scored = sorted(((-sum(a * b for a, b in zip(qv, c)), int(i)) for i, c in zip(cand_ids, wide_c) if i != query_ids[q]))
            for s, i in scored[:top]:
                yield q, i, max(-(1 << 63), min((1 << 63) - 1, -s))
        return
    order = np.argsort(-(cand * cand).sum(axis=1), kind="stable")
    cand, query = cand[order], query[order]
    starts = list(range(0, width, step))
    mass = lambda m: np.sqrt(np.cumsum((m * m)[::-1], axis=0)[::-1])
    mass_c, mass_q = (mass(cand), mass(query)) if width else (cand, query)
    if reached is not None and np.isfinite(reached).all():
        for q in range(0, query.shape[1], 128):
            some = slice(q, q + 128)
            yield from ((q + n, i, x) for n, i, x in _beyond(
                cand_ids, cand, query_ids[some], query[:, some], top, step, starts, mass_c, mass_q[:, some], reached[some]))
        return
    first = cand[:step].T @ query[:step] if width else np.zeros((cand.shape[1], query.shape[1]))
    for q in range(query.shape[1]):
        alive = np.flatnonzero(cand_ids != query_ids[q])
        partial = first[alive, q]
        for at in starts[1:]:
            rest = mass_c[at, alive] * mass_q[at, q] * (1 + 1e-9) + 1e-6
            if len(alive) > top:
                threshold = np.partition(partial - rest, len(alive) - top)[len(alive) - top]
                stay = partial + rest >= threshold
                if not stay.all():
                    alive, partial = alive[stay], partial[stay]
            partial = partial + query[at:at + step, q] @ cand[at:at + step, alive]
        if len(alive) > top:
            threshold = np.partition(partial, len(alive) - top)[len(alive) - top]
            stay = partial >= threshold
            alive, partial = alive[stay], partial[stay]
        for j in np.lexsort((cand_ids[alive], -partial))[:top]:
            yield q, int(cand_ids[alive[j]]), int(partial[j])


def _beyond(cand_ids, cand, query_ids, query, top, step, starts, mass_c, mass_q, reached):
    """``best_of_cell`` for some queries at once, with the thresholds they bring: whole matrices until few pairs are left, then pair by pair.

    Whether few are left is looked up on every 64th candidate first.
    """
    import numpy as np

    limit, found = reached - 1e-6, []
    for low in range(0, cand.shape[1], 4096):
        part = cand[:, low:low + 4096]
        total = part[:step].T @ query[:step] if starts else np.zeros((part.shape[1], query.shape[1]))
        pairs = None
        for at in starts[1:]:
            if pairs is None:
                rest_c, rest_q = mass_c[at, low:low + 4096], mass_q[at] * (1 + 1e-9)
                few = total[::64] + np.multiply.outer(rest_c[::64], rest_q) >= limit
                if np.count_nonzero(few) * 8 > few.size:
                    total += part[at:at + step].T @ query[at:at + step]
                    continue
                bound = np.multiply.outer(rest_c, rest_q)
                bound += total
                c, q = np.nonzero(bound >= limit)
                partial = total[c, q]
            else:
                c, q = pairs
                stay = partial + mass_c[at, low + c] * mass_q[at, q] * (1 + 1e-9) >= limit[q]
                c, q, partial = c[stay], q[stay], partial[stay]
            pairs = c, q
            partial = partial + sum((part[d, c] * query[d, q] for d in range(at, min(at + step, len(cand)))), np.zeros(len(c)))
        if pairs is None:
            pairs = np.nonzero(total >= reached)
            partial = total[pairs]
        c, q = pairs
        stay = (partial >= reached[q]) & (cand_ids[low + c] != query_ids[q])
        found.append((low + c[stay], q[stay], partial[stay]))
    c, q, partial = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    order = np.lexsort((cand_ids[c], -partial, q))
    c, q, partial = c[order], q[order], partial[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    for n in np.flatnonzero(rank < top):
        yield int(q[n]), int(cand_ids[c[n]]), int(partial[n])


def _pieces(blocks):
    """(ids, dimension x vector) of packed ``blocks`` (n, width, kind, ids, columns), several together up to PIECE components.

    Blocks with numbers that are no whole numbers of 32 bits stay alone, as does the first, which gives the others their threshold.
    """
    import numpy as np

    held, size, first = [], 0, True

    def joined():
        width = max(g.shape[0] for _, g in held)
        return np.concatenate([i for i, _ in held]), np.concatenate([np.pad(g, ((0, width - g.shape[0]), (0, 0))) for _, g in held], axis=1)

    for r in blocks:
        one = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["columns"], r["kind"]).reshape(r["width"], r["n"]).astype(np.float64)
        if held and (r["kind"] == "float64" or size + one[1].size > PIECE):
            yield joined()
            held, size = [], 0
        if r["kind"] == "float64" or first:
            first = False
            yield one
        else:
            held.append(one)
            size += one[1].size
    if held:
        yield joined()


def top_products(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding",
                 top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` candidates of ``vectors`` for every row of ``queries``.

    Score: inner product of the whole-number vectors; ties go to the smaller id; candidates with the query's own id are
    left out.  Both sides are packed in blocks.  A cell holds many candidate blocks and many query blocks, which meet by an equality
    key, so every query block meets every candidate block once and a block is copied once for every cell it lies in, not for
    every block it meets.  Neither side is sent to the driver.  A cell keeps the best ``top`` of every query from one piece of
    its candidates to the next, as the threshold, and hands on these only.

    Vectors that are null or hold a null or non-finite component, and rows without a key, take no part on either side.  Components
    beyond 2^63 / 256 saturate at a long's limits, as do scores beyond a long.
    Empty vectors score 0; of vectors of different lengths the shorter one ends in zeros.  Repeated rows are candidates,
    and queries, of their own.  Empty tables give no rows; extra columns are ignored.
    """
    arrow_rows(vectors.sparkSession, BLOCK)
    cand = cut_lineage(_packed(whole_vectors(vectors, key, vector)))
    asked = cut_lineage(_packed(whole_vectors(queries, key, vector)).withColumn("block", F.monotonically_increasing_id()))
    arrow_rows(vectors.sparkSession, 16)

    def spread(df: DataFrame, most: int, least: int = 1) -> int:
        """Cells along a side: by its size, and as many as ``least`` where it has so many blocks."""
        size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("n").cast("long") * F.col("width")), F.lit(0)).alias("size")).first()
        return max(ceil(size["size"] / most), min(size["n"], least), 1)

    across = spread(asked, ASKED)
    along = spread(cand, CELL, ceil(CELLS / across))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = cand.withColumns({"a": F.pmod(F.xxhash64("ids"), F.lit(along).cast("long")).cast("int"), "b": every(across)})
    asked = asked.withColumns({"b": F.pmod(F.xxhash64("block"), F.lit(across).cast("long")).cast("int"), "a": every(along)})

    def searched(candidates, questions):
        import numpy as np
        import pyarrow as pa

        questions = [r | {"best": {}, "reached": np.full(r["n"], -np.inf)} for r in questions.to_pylist()]
        for ids, grid in _pieces(candidates.select(["n", "width", "kind", "ids", "columns"]).to_pylist()):
            for r in questions:
                qids = np.frombuffer(r["ids"], np.int64)
                qgrid = np.frombuffer(r["columns"], r["kind"]).reshape(r["width"], r["n"]).astype(np.float64)
                step = r["n"] if np.isfinite(r["reached"]).all() else 128
                for at in range(0, r["n"], step):
                    some = slice(at, at + step)
                    met: dict[int, list] = {}
                    for q, i, s in best_of_cell(ids, grid, qids[some], qgrid[:, some], top, reached=r["reached"][some]):
                        met.setdefault(at + q, []).append((-s, i))
                    for q, more in met.items():
                        best = r["best"][q] = sorted(r["best"].get(q, []) + more)[:top]
                        if len(best) == top:
                            r["reached"][q] = float(-best[-1][0])
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        out = [(r["block"], q, int(qid), i, -s) for r in questions for q, qid in enumerate(np.frombuffer(r["ids"], np.int64)) for s, i in r["best"].get(q, [])]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)],
                                    names=["block", "q", "query_id", "vec_id", "score"])

    sides = [df.repartition(along * across, "a", "b").groupBy("a", "b") for df in (cand, asked)]
    found = sides[0].cogroup(sides[1]).applyInArrow(searched, "block long, q int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
