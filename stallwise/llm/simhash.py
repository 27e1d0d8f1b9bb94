"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut_lineage, fresh

BITS = 64
SEGMENTS = 2  # two differing bits over two segments leave one segment with at most one
HALF = BITS // SEGMENTS
SHINGLE = 3
SEED = 42
MAX_BITS = 2


def fingerprint_bytes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text; 0 for a text without words."""
    import numpy as np
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        hashes = [digest(b" ".join(parts), seed)]
    else:
        joined, at = b" ".join(parts), 0
        starts, ends = [], []
        for p in parts:
            starts.append(at)
            at += len(p)
            ends.append(at)
            at += 1
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1:])]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus a signed 64-bit fingerprint, computed in Arrow batches; no rows move."""
    import pyarrow as pa

    position = docs.columns.index(text)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint_bytes(t.as_py(), shingle) for t in batch.column(position)]
            signed = pa.array([v - (1 << BITS) if v >> (BITS - 1) else v for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, signed], names=[*batch.schema.names, out])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(mapped, StructType([*docs.schema.fields, StructField(out, LongType())]))


def wildcard_keys(fp: Column) -> Column:
    """The 64 one-wildcard variants of both segments, each packed with its wildcard's place into one long.

    A segment has 32 bits; without the wildcard's bit 31 are left.  Bits 0..31 hold the masked segment and bits 32..37
    the place among 64, which also names the segment.
    """
    segment = [F.shiftrightunsigned(fp, HALF), fp.bitwiseAND(F.lit((1 << HALF) - 1))]
    return F.array(*[
        segment[s].bitwiseAND(F.lit((1 << HALF) - 1 - (1 << i))).bitwiseOR(F.lit((s * HALF + i) << HALF))
        for s in range(SEGMENTS) for i in range(HALF)])


def ball(fp: Column) -> Column:
    """The fingerprint and its 64 one-bit neighbours."""
    flips = [1 << i for i in range(BITS - 1)] + [-(1 << (BITS - 1))]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(x)) for x in flips])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all that differ in at most two bits.

    One-wildcard segment variants are the equality keys.  A key that two fingerprints share is one pair, verified by
    its differing bits.  The fingerprints of a key that more share are never paired with each other: each is indexed under
    its 65 neighbours within one bit.  Two that differ in at most two bits meet under one of them, and all
    that meet there are at most two bits apart, so a star to the smallest of them is enough.  Work is linear in the
    fingerprints, whatever the group.
    """
    keyed = prints.select("fp", F.explode(wildcard_keys(F.col("fp"))).alias("k"))
    shared = cut_lineage(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                         .where("n > 1"))
    pairs = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    # written, as it is read twice; always a sorted join, so that the plan is the same at every size
    crowded = cut_lineage(keyed.join(shared.where("n > 2").select("k").hint("merge"), "k", "left_semi").select("fp").distinct())
    near = crowded.select("fp", F.explode(ball(F.col("fp"))).alias("centre"))
    lowest = near.groupBy("centre").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("centre", "a")
    stars = near.join(lowest, "centre").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _grouped(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, group, component_id); ``group`` is the smallest fingerprint that can be reached."""
    hashed = cut_lineage(with_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), shingle=shingle)
                         .select("doc_id", "fp"))
    prints = cut_lineage(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(links(prints.select("fp")))
    placed = prints.join(nodes, prints["fp"] == nodes["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group"))
    smallest = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "group").select(F.col("fp").alias("f"), "group", "component_id")
    return hashed.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "group", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits), ``component_id``.

    The component is the smallest ``key`` among all rows whose fingerprint can be reached over links of at most two
    differing bits.  Null and blank texts have fingerprint zero and link like any other.  Equal texts and repeated rows
    share one fingerprint and so one component; rows with a null key get the component's smallest key that is not null
    (null if there is none).  An empty table gives no rows; extra columns are ignored.
    """
    return _grouped(docs, key, text).select(
        F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, columns unchanged: the row with the smallest key.

    ``shingle``: words of a shingle.

    Of several rows with that key (repeated rows) one stays.  A group whose keys are all null keeps one of its rows.
    """
    found = cut_lineage(_grouped(docs, key, text, shingle))
    keep = found.where("component_id is not null and doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.where(F.col(key).isNotNull()).join(keep, key, "left_semi").dropDuplicates([key])
    fp = fresh(docs, "fp")
    alone = found.where("component_id is null and fp = group").select(F.col("fp").alias(fp)).distinct()
    unnamed = with_fingerprint(docs.where(F.col(key).isNull()), text, fp, shingle).join(alone, fp, "left_semi").dropDuplicates([fp])
    return named.select(*docs.columns).unionByName(unnamed.select(*docs.columns))
