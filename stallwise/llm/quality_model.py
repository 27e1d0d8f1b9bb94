"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import arrow_rows, fresh

HELD_OUT = 2  # remainder of crc32(doc_id as text) modulo 4 that is never learned from
ACCEPT = 0.7


@dataclass(frozen=True)
class QualitySettings:
    """``sample_rows`` bounds the labelled rows that are learned from (the first by a hash of their id)."""

    sample_rows: int = 5000
    least_documents: int = 4
    smoothing: float = 1.0
    penalty: float = 0.05
    epochs: int = 20
    folds: int = 3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights; ``slope`` and ``shift`` turn a margin into a probability."""

    keys: object
    weights: object
    bias: float
    slope: float
    shift: float


_CACHE_WORDS = 400_000


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, runs of anything as one: ``Abc12!!`` is ``Aa0!``."""
    out = []
    for ch in word:
        c = ("A" if ch.isupper() else "a") if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out[:8])


def features(text: str | None, cache: dict):
    """Distinct feature hashes of a text: words, and one to three neighbouring word shapes.

    A shape also says whether the word equals the one before it.
    """
    import numpy as np
    import xxhash

    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    for w in set(tokens):
        if w not in cache:
            cache[w] = (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1),
                        xxhash.xxh64_intdigest(shape(w).encode("utf-8", "surrogatepass"), 2))
    pairs = [cache[w] for w in tokens]
    word = np.fromiter((p[0] for p in pairs), np.uint64, len(pairs))
    one = np.fromiter((p[1] for p in pairs), np.uint64, len(pairs))
    one[1:][word[1:] == word[:-1]] ^= np.uint64(0x5BD1E995)
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = one[:-1] * mix + one[1:]
        three = two[:-1] * mix + one[2:]
    return np.unique(np.concatenate([word, one, two, three]))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``sample_rows`` labelled rows outside the held-out quarter.

    A document with several labels has the largest, null labels do not count; of several texts of one id the one with the smallest
    hash is used, so a repeated id is one row.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label"))
    seen = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != HELD_OUT)
    some = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    narrow = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return narrow.join(some, "doc_id").groupBy("doc_id", "label").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def dual_descent(rows, signs, values, width: int, settings: QualitySettings, seed: int):
    """Weights (the last one is the bias) of the hinge loss by dual coordinate descent over sparse ``rows``."""
    import numpy as np

    dice = np.random.default_rng(seed)
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    scaled = [(np.append(r, width), np.append(values[r], 1.0)) for r in rows]
    square = np.array([v @ v for _, v in scaled])
    share = np.where(signs > 0, 0.5 / max((signs > 0).sum(), 1), 0.5 / max((signs < 0).sum(), 1)) * len(rows)
    cap = settings.penalty * share
    for _ in range(settings.epochs):
        moved = 0.0
        for i in dice.permutation(len(rows)):
            at, v = scaled[i]
            slope = signs[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cap[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * signs[i] * v
                moved = max(moved, abs(new - alpha[i]) * square[i] ** 0.5)
                alpha[i] = new
        if moved < 1e-4:  # no weight vector step is longer than this
            break
    return w


def _ratios(rows, labels, width: int, smoothing: float):
    import numpy as np

    totals = [np.full(width, smoothing), np.full(width, smoothing)]
    for r, y in zip(rows, labels):
        totals[y][r] += 1
    counts = [max(int((labels == y).sum()), 1) + 2 * smoothing for y in (0, 1)]
    return np.log((totals[1] / counts[1]) / (totals[0] / counts[0]))


def calibrated(margins, labels) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by Newton steps on slightly drawn-in targets."""
    import numpy as np

    good, bad = (labels == 1).sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - goal) + 1e-3 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings(), key: str = "doc_id", text: str = "text") -> Model:
    """The model, learned from a bounded sample of labelled rows; features are made in Spark tasks.

    Without labels of both kinds every text scores the share of label 1 (1 without any label: nothing speaks against it).
    """
    import numpy as np

    arrow_rows(docs.sparkSession, 256)

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            found = [features(t.as_py(), cache).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in found], pa.binary())],
                                             names=["doc_id", "label", "f"])

    got = training_rows(docs, labels, "quality", settings.sample_rows, key, text).mapInArrow(
        mapped, "doc_id long, label int, f binary").toPandas()
    got = got.sort_values(["doc_id", "f"], kind="stable")
    y = (got["label"].to_numpy() > 0).astype(int)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    raw = [np.frombuffer(b, np.uint64) for b in got["f"]]
    every, counts = np.unique(np.concatenate(raw), return_counts=True)
    keys = every[counts >= min(settings.least_documents, max(1, len(raw) // 50))]

    def placed(r):
        at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
        return at[keys[at] == r]

    rows = [placed(r) for r in raw] if len(keys) else [np.zeros(0, np.int64) for _ in raw]
    rows = [r.astype(np.int64) for r in rows]
    signs = 2 * y - 1
    folds = np.arange(len(rows)) % settings.folds
    margins = np.zeros(len(rows))
    for k in range(settings.folds):
        inside = np.flatnonzero(folds != k)
        ratio = _ratios([rows[i] for i in inside], y[inside], len(keys), settings.smoothing)
        w = dual_descent([rows[i] for i in inside], signs[inside], ratio, len(keys), settings, settings.seed + k)
        whole = w[:-1] * ratio
        for i in np.flatnonzero(folds == k):
            margins[i] = whole[rows[i]].sum() + w[-1]
    slope, shift = calibrated(margins, y)
    ratio = _ratios(rows, y, len(keys), settings.smoothing)
    w = dual_descent(rows, signs, ratio, len(keys), settings, settings.seed)
    weights = w[:-1] * ratio
    used = weights != 0
    return Model(keys[used], weights[used], float(w[-1]), slope, shift)


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus the score of every whole text, between 0 and 1.  No rows move; null texts score like empty ones."""
    arrow_rows(docs.sparkSession, 256)
    position = docs.columns.index(text)

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            margins = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(position)):
                f = features(t.as_py(), cache)
                total = model.bias
                if len(f) and len(model.keys):
                    at = np.minimum(np.searchsorted(model.keys, f), len(model.keys) - 1)
                    total += model.weights[at[model.keys[at] == f]].sum()
                margins[i] = total
            score = 1 / (1 + np.exp(-np.clip(model.slope * margins + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(mapped, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings(), key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted), one row per row of ``docs``.

    Null and blank texts get the score of a text without features.  A null key is not held out.  Repeated rows score alike;
    an empty table gives no rows; extra columns are ignored.
    """
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    out = with_score(narrow, fit(docs, labels, settings, key, text))
    held = F.coalesce(F.crc32(F.col("k").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return out.select(F.col("k").alias(key), held.cast(BooleanType()).alias("held_out"), "score",
                      (F.col("score") >= ACCEPT).cast(IntegerType()).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings(), text: str = "text") -> DataFrame:
    """``docs`` without the rows that score below the acceptance level, columns unchanged."""
    score = fresh(docs, "score")
    return with_score(docs, fit(docs, labels, settings), text, score).where(F.col(score) >= ACCEPT).drop(score)
