"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage
from .quality_model import HELD_OUT, training_rows

GRADES = 4  # 0 none, 1 mild, 2 strong, 3 severe
# Grade of a toxic document by the marked words it holds: up to 1 is mild, up to 3 strong, more is severe.
GRADE_STEPS = (1, 3)
FLAG = 0.4  # probability of any grade above 0 from which a text counts as toxic


@dataclass(frozen=True)
class ToxicSettings:
    """``sample_rows`` bounds the labelled rows that are learned from; ``features`` bounds the vocabulary."""

    sample_rows: int = 12000
    least_documents: int = 3
    features: int = 1024
    marked_odds: float = 8.0
    ridge: float = 0.0005
    rounds: int = 300


@dataclass(frozen=True)
class Model:
    """Sorted features, one shared weight each, and the thresholds between the grades."""

    keys: object
    weights: object
    thresholds: object


_CACHE_WORDS = 400_000


def bare(word: str) -> str:
    """Lower case, letters only."""
    if word.isalpha():
        return word.lower()
    return "".join(c for c in word if c.isalpha()).lower()


def stems(word: str) -> list[int]:
    """Features of a word: its first four letters (odd numbers), its first five and the whole word (even numbers).

    Insults are often inflected or compounded: the stems carry what single forms are too rare to show.
    """
    import xxhash

    b = bare(word)
    if not b:
        return []
    digest = lambda kind, part: xxhash.xxh64_intdigest((kind + part).encode("utf-8", "surrogatepass"), 3)
    out = [digest("4", b[:4]) | 1]
    return out + [digest(k, part) & ~1 for k, part in (("5", b[:5]), ("w", b)) if len(part) > 4]


def counts(text: str | None, cache: dict):
    """(features, counts) of the words of a text."""
    import numpy as np

    tokens = (text or "").split()
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    for w in set(tokens):
        if w not in cache:
            cache[w] = stems(w)
    found = [f for w in tokens for f in cache[w]]
    return np.unique(np.array(found, np.uint64), return_counts=True)


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grade_shares(linear, thresholds):
    """Probability of every grade, from P(grade <= k) = logistic(threshold_k - linear)."""
    import numpy as np

    upto = np.concatenate([_sigmoid(thresholds[None, :] - linear[:, None]), np.ones((len(linear), 1))], axis=1)
    return np.diff(upto, axis=1, prepend=0.0)


def ordinal_fit(rows, columns, values, grades, width: int, ridge: float, rounds: int):
    """(weights, thresholds) of the cumulative-link model: adaptive gradient steps on the whole sample.

    ``rows``, ``columns``, ``values`` are the sparse features.  The thresholds are a first one and positive steps, so they
    stay in order; the weights are shared by all of them.
    """
    import numpy as np

    n, levels = len(grades), GRADES - 1
    share = np.array([(np.sum(grades <= k) + 1) / (n + 2) for k in range(levels)])
    start = np.log(share / (1 - share))
    steps = np.maximum(np.diff(start), 0.1)
    params = np.concatenate([np.zeros(width), start[:1], np.log(steps)])
    one, two = np.zeros_like(params), np.zeros_like(params)
    rate = 0.1
    for t in range(1, rounds + 1):
        w, first, gaps = params[:width], params[width], np.exp(params[width + 1:])
        cut = np.concatenate([[first], first + np.cumsum(gaps)])
        linear = np.bincount(rows, values * w[columns], minlength=n)
        upto = _sigmoid(cut[None, :] - linear[:, None])
        edge = np.concatenate([np.zeros((n, 1)), upto, np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        own = np.arange(n)
        mass = np.maximum(edge[own, grades + 1] - edge[own, grades], 1e-9)
        d_high, d_low = slope[own, grades + 1] / mass, slope[own, grades] / mass
        d_linear = (d_high - d_low) / n  # of the negative mean log-likelihood
        d_cut = np.zeros(levels)
        for k in range(levels):
            d_cut[k] = (-d_high[grades == k].sum() + d_low[grades == k + 1].sum()) / n
        d_w = np.bincount(columns, values * d_linear[rows], minlength=width) + ridge * w / n
        d_gaps = np.array([d_cut[k + 1:].sum() * gaps[k] for k in range(levels - 1)])
        gradient = np.concatenate([d_w, [d_cut.sum()], d_gaps])
        one = 0.9 * one + 0.1 * gradient
        two = 0.999 * two + 0.001 * gradient * gradient
        params = params - rate * (one / (1 - 0.9 ** t)) / (np.sqrt(two / (1 - 0.999 ** t)) + 1e-8)
    gaps = np.exp(params[width + 1:])
    return params[:width], np.concatenate([[params[width]], params[width] + np.cumsum(gaps)])


def telling_features(sample: DataFrame, settings: ToxicSettings) -> tuple:
    """(sorted features, whether each marks an insult): those that speak for toxic rows most, and often.

    Rows per feature and label are counted in Spark; only the chosen features reach the driver.
    """
    import numpy as np

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            found = [np.append(counts(t.as_py(), cache)[0], np.uint64(0)).view(np.int64) for t in batch.column(2)]  # 0: every row
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))],
                                             names=["label", "f"])

    seen = sample.mapInArrow(mapped, "label int, f array<long>").select("label", F.explode("f").alias("f"))
    stats = cut_lineage(seen.groupBy("f").agg(F.count_if(F.col("label") > 0).alias("toxic"), F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") >= settings.least_documents))
    total = stats.where("f = 0").first()
    if total is None or not 0 < total["toxic"] < total["n"]:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    share = (F.col("toxic") + 0.5) / F.lit(total["toxic"] + 1.0)
    clean = (F.col("n") - F.col("toxic") + 0.5) / F.lit(total["n"] - total["toxic"] + 1.0)
    best = stats.where("f <> 0").withColumn("ratio", F.log(share / clean)).where("ratio > 0").orderBy(
        F.desc(F.col("ratio") * F.sqrt("toxic")), "f").limit(settings.features).toPandas()
    keys = best["f"].to_numpy(np.int64).view(np.uint64)
    marks = (best["ratio"] >= np.log(settings.marked_odds)).to_numpy() & (best["toxic"] >= settings.least_documents).to_numpy() & (
        keys % np.uint64(2) == 1)
    order = np.argsort(keys)
    return keys[order], marks[order]


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicSettings = ToxicSettings(), key: str = "doc_id", text: str = "text") -> Model:
    """The model, learned from a bounded sample of labelled rows outside the held-out quarter.

    Labels say toxic or not.  The grade of a toxic row comes from its marked words: those whose first four letters have
    odds of standing in a toxic row that are ``marked_odds`` times those of a clean one.  Without labels of both kinds, or
    without a telling feature, nothing is toxic.
    """
    import numpy as np

    arrow_rows(docs.sparkSession, 256)
    sample = training_rows(docs, labels, "toxic", settings.sample_rows, key, text)
    keys, marks = telling_features(sample, settings)
    if not len(keys):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([20.0, 21.0, 22.0]))

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            found = []
            for t in batch.column(2):
                h, c = counts(t.as_py(), cache)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = keys[at] == h
                found.append((at[same].astype(np.int32), c[same].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([f[0].tobytes() for f in found], pa.binary()),
                pa.array([f[1].tobytes() for f in found], pa.binary())], names=["doc_id", "label", "f", "c"])

    got = sample.mapInArrow(mapped, "doc_id long, label int, f binary, c binary").toPandas().sort_values(["doc_id", "f"], kind="stable")
    y = (got["label"].to_numpy() > 0).astype(int)
    columns = [np.frombuffer(b, np.int32) for b in got["f"]]
    rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    columns, times = np.concatenate(columns), np.concatenate([np.frombuffer(b, np.int32) for b in got["c"]])
    hits = np.bincount(rows, times * marks[columns], minlength=len(y))
    grades = np.where(y == 0, 0, 1 + sum((hits > s).astype(int) for s in GRADE_STEPS))
    weights, cuts = ordinal_fit(rows, columns, np.log2(1.0 + times), grades, len(keys), settings.ridge * len(grades), settings.rounds)
    return Model(keys, weights, cuts)


def graded(docs: DataFrame, labels: DataFrame, settings: ToxicSettings = ToxicSettings(), key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, held_out, p_toxic, expected_severity, grade, toxic), one row per row of ``docs``.

    ``p_toxic`` is the probability of any grade above 0, ``expected_severity`` the mean grade (0 to 3), ``grade`` the
    likeliest one, ``toxic`` whether ``p_toxic`` reaches ``FLAG``.  Null and blank texts are graded without features.
    Repeated rows are graded alike; an empty table gives no rows; extra columns are ignored.
    """
    model = fit(docs, labels, settings, key, text)
    arrow_rows(docs.sparkSession, 256)

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        index = {int(k): i for i, k in enumerate(model.keys)}
        cache: dict = {}  # word -> places of its features in the model; for most words there are none
        for batch in batches:
            linear = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(1)):
                tokens = (t.as_py() or "").split()
                if len(cache) > _CACHE_WORDS:
                    cache.clear()
                for w in set(tokens):
                    if w not in cache:
                        cache[w] = [index[f] for f in stems(w) if f in index]
                at = [j for w in tokens for j in cache[w]]
                if at:
                    places, number = np.unique(at, return_counts=True)
                    linear[i] = (model.weights[places] * np.log2(1.0 + number)).sum()
            shares = grade_shares(linear, model.thresholds)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(1 - shares[:, 0], pa.float64()), pa.array(shares @ np.arange(GRADES), pa.float64()),
                pa.array(shares.argmax(axis=1).astype(np.int32), pa.int32())], names=["k", "p_toxic", "expected_severity", "grade"])

    narrow = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    out = narrow.mapInArrow(mapped, "k long, p_toxic double, expected_severity double, grade int")
    held = F.coalesce(F.crc32(F.col("k").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return out.select(F.col("k").alias(key), held.alias("held_out"), "p_toxic", "expected_severity", "grade",
                      (F.col("p_toxic") >= FLAG).alias("toxic"))
