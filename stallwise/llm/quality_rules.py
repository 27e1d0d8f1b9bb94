"""Quality rules: text measures per document and the frequency of lines across the documents of a host.

Only DataFrame functions: texts are read once and never shuffled; what moves are line hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, components, cut_lineage, words

# Fixed values of the measures.
SYMBOLS = r"[#*$%&|<>]"
GRAM = 3
MIN_WORDS = 50
REPEAT_PERCENT = 50

SKETCH = 128  # smallest window hashes that are kept of a text
DRAWS = 4  # minima of the sketch; texts meet under every two of them
FEW = 16  # texts that meet are compared pair by pair up to so many; more are compared with HUBS of them first, then in blocks
HUBS = 4
BLOCK = 128  # texts of a block


@dataclass(frozen=True)
class RuleSettings:
    """A line is boilerplate of its host when it stands in more distinct documents than both limits.

    Two texts count as one document when ``copy_share`` of their windows are the same, and so do those that a chain of such texts
    joins.  ``least_documents`` and ``share`` (of the host's distinct documents) bound a line's documents; a document is depleted
    when less than ``kept_share`` of its words are left without such lines.
    """

    least_documents: int = 20
    share: float = 0.05
    kept_share: float = 0.3
    copy_share: float = 0.95


def normalised(line: Column) -> Column:
    """Lower case, digits as one 0, white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), SPACE, " "))


def _sorted_windows(w: Column, n: Column) -> Column:
    """Three-word windows in an order that brings repeats together: (packed, mask).

    A window is one long, a hash's upper bits with the window's place in the lower ones, so that a plain sort of numbers
    does.  Windows whose upper bits have a neighbour are candidates: no repeated window is missed.
    """
    places = F.greatest(n - (GRAM - 1), F.lit(0))
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double") + 1)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    near = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    packed = F.sort_array(F.transform(
        F.slice(near, 1, places.cast("int")), lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
    return F.struct(packed.alias("packed"), mask.alias("mask"))


def _windows(w: Column) -> Column:
    """The distinct three-word windows of an array of words, as hashes."""
    near = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.array_distinct(F.slice(near, F.lit(1), F.greatest(F.size(w) - (GRAM - 1), F.lit(0))))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: the measures, the host, a sketch of the text's windows and its lines as (hash, words)."""
    base = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = base.withColumn("w", words(F.col("t"))).withColumn("n", F.size("w"))
    w = F.col("w")
    packed = _sorted_windows(w, F.col("n"))
    staged = split.withColumn("p", packed)
    p, mask = F.col("p.packed"), F.col("p.mask")
    top = lambda x: x.bitwiseAND(F.bitwise_not(mask))
    staged = staged.withColumn("c", F.filter(p, lambda x, i: (
        (i > 0) & (top(x) == top(F.get(p, i - 1)))) | F.coalesce(top(x) == top(F.get(p, i + 1)), F.lit(False))))
    place = lambda x: x.bitwiseAND(mask).cast("int")
    # the candidates, mostly true repeats, are sorted again by their words, which decides exactly
    exact = F.array_sort(F.transform(F.col("c"), lambda x: F.struct(
        F.concat_ws(" ", F.get(w, place(x)), F.get(w, place(x) + 1), F.get(w, place(x) + 2)).alias("g"), place(x).alias("at"))))
    staged = staged.withColumn("e", exact)
    e = F.col("e")
    hits = F.sort_array(F.transform(F.filter(e, lambda x, i: (
        (i > 0) & (x["g"] == F.get(e, i - 1)["g"])) | F.coalesce(x["g"] == F.get(e, i + 1)["g"], F.lit(False))), lambda x: x["at"]))
    staged = staged.withColumn("h", hits)
    h = F.col("h")
    covered = F.aggregate(F.transform(h, lambda x, i: F.least(F.lit(GRAM), F.coalesce(F.get(h, i + 1) - x, F.lit(GRAM)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = staged.withColumn("l", lines).withColumn("u", F.array_distinct("l"))
    symbol_free = F.length(F.regexp_replace("t", SYMBOLS + "+", ""))
    return staged.select(
        "doc_id", "host", F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - symbol_free).cast("long").alias("n_symbols"),
        (F.size("l") - F.size("u")).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        # packed windows are sorted, and their places never reach the upper half
        F.slice(F.array_distinct(F.transform("p.packed", lambda x: F.shiftright(x, 32).cast("int"))), 1, SKETCH).alias("sketch"),
        F.xxhash64("t").alias("text_hash"),
        F.transform("l", lambda x: F.struct(
            F.xxhash64(normalised(x)).alias("h"), F.size(words(x)).alias("n"))).alias("lines"))


def document_node() -> Column:
    """The name of a text on its host."""
    return F.xxhash64("hk", "text_hash")


def _keys() -> Column:
    """The keys under which a text (hk, sketch) meets others: one for every two of its draws."""
    # a second argument of the lambda would be the place in the array, hence one function per draw
    draw = lambda d: F.array_min(F.transform("sketch", lambda x: F.xxhash64(x, F.lit(d))))
    drawn = F.struct(*[draw(d).alias(f"v{d}") for d in range(DRAWS)])
    return F.transform(F.array(drawn), lambda v: F.array(*[
        F.xxhash64("hk", F.lit(c), v[f"v{c}"], F.lit(d), v[f"v{d}"]) for c in range(DRAWS) for d in range(c + 1, DRAWS)]))[0]


def _pairs_in_crowds(crowd: DataFrame, same: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the texts that meet under a key of ``crowd`` (k, node) and may be alike, but lie in different components of ``same``.

    Every two such texts are looked at, once: under the first key that they share.  The texts of a key are dealt over blocks of about
    ``BLOCK``, those of its largest component over blocks of their own, which need not meet each other; two blocks that meet
    are a row, and only the pairs whose sketches are alike leave it.
    """
    placed = cut_lineage(crowd.join(same, "node", "left").select("k", "node", F.coalesce("component", "node").alias("c")))
    held = placed.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(
        F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("n")).where(F.col("n") > F.col("main.n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("node", "k"), n.cast("long")).cast("int")
    main, rest = blocks(F.col("main.n")), blocks(F.col("n") - F.col("main.n"))
    is_main = F.col("c") == F.col("main.c")
    rows = placed.join(held, "k").select(
        "k", "node", "c", rest.alias("rest"), (rest + main).alias("all"), is_main.alias("is_main"),
        F.when(is_main, rest + dealt(main)).otherwise(dealt(rest)).alias("at"))
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rest")).otherwise(F.col("all")) - 1)))
    wanted = cut_lineage(sketches.join(placed.select("node").distinct(), "node", "left_semi").select("node", "sketch", _keys().alias("keys")))
    text = F.struct("node", "c", "sketch", "keys")
    cells = rows.join(wanted, "node").groupBy("k", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j")).agg(
        F.collect_list(F.when(F.col("at") <= F.col("to"), text)).alias("x"), F.collect_list(F.when(F.col("at") > F.col("to"), text)).alias("y"))

    def alike(a: Column, b: Column) -> Column:
        small, large = F.least(F.size(a["sketch"]), F.size(b["sketch"])), F.greatest(F.size(a["sketch"]), F.size(b["sketch"]))
        first = F.get(F.filter(a["keys"], lambda k, p: k == F.get(b["keys"], p)), F.lit(0))
        return ((a["c"] != b["c"]) & ((F.col("i") < F.col("j")) | (a["node"] < b["node"])) & (small >= least * large)
                & (first == F.col("k")) & (F.size(F.array_intersect(a["sketch"], b["sketch"])) >= least * large))

    other = F.when(F.col("i") < F.col("j"), F.col("y")).otherwise(F.col("x"))
    met = F.flatten(F.transform("x", lambda a: F.transform(F.filter(F.col("other"), lambda b: alike(a, b)), lambda b: F.struct(
        F.least(a["node"], b["node"]).alias("a"), F.greatest(a["node"], b["node"]).alias("b")))))
    return cells.select("k", "i", "j", "x", other.alias("other")).select(F.explode(met).alias("p")).select("p.a", "p.b")


def copies(found: DataFrame, texts: DataFrame, copy_share: float) -> DataFrame:
    """(node, component) of the texts (``document_node``) that copy others of their host: one component per group.

    Texts meet under two of four minima of their sketches; two with 95 % of their windows alike do so with a probability of
    0.9995, two that share a passage seldom.  All that meet are compared.  In a crowd each is first compared with ``HUBS`` of them, which joins a
    large group at little cost; then every two that are still in different components are (``_pairs_in_crowds``).  Links are followed
    through.  The smallest ``SKETCH`` windows of both estimate the share of equal windows; where it may reach the limit, the
    whole windows of the two ``texts`` (text_hash, t) are compared.
    """
    once = cut_lineage(found.where(F.size("sketch") > 0).withColumn("node", document_node()).groupBy("node").agg(F.min("rid").alias("rid")))
    sketches = cut_lineage(found.select("rid", "hk", "text_hash", "sketch").join(once, "rid").drop("rid"))
    keyed = cut_lineage(sketches.select("node", F.explode(_keys()).alias("k")))
    hubs = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(r))) for r in range(HUBS)]))
    groups = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), hubs.alias("hubs")).where("n > 1")
    met = cut_lineage(keyed.join(groups, "k"))
    few, crowd = met.where(F.col("n") <= FEW), met.where(F.col("n") > FEW)
    pairs = few.select("k", F.col("node").alias("a")).join(few.select("k", F.col("node").alias("b")), "k").where("a < b").select("a", "b").unionByName(
        crowd.select("node", F.explode("hubs").alias("hub")).where("node <> hub").select(
            F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))
    least = copy_share - 4 * (copy_share * (1 - copy_share) / SKETCH) ** 0.5  # four standard errors below the limit
    same = components(_verified(pairs, sketches, texts, copy_share, least))
    if crowd.isEmpty():
        return same
    more = cut_lineage(_verified(_pairs_in_crowds(crowd.select("k", "node"), same, sketches, least), sketches, texts, copy_share, least))
    if more.isEmpty():
        return same
    return components(same.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, copy_share: float, least: float) -> DataFrame:
    """Those of the pairs (a, b) with ``copy_share`` of their windows alike; ``least`` is the share of equal sketches from which whole windows are read."""
    side = lambda df, node, **more: df.select(F.col("node").alias(node), *[F.col(c).alias(n) for n, c in more.items()])
    both = pairs.distinct().join(side(sketches, "a", sketch="sketch", text_a="text_hash"), "a").join(
        side(sketches, "b", other="sketch", text_b="text_hash"), "b")
    union = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    common = F.array_intersect("sketch", "other")
    possible = F.size(common) >= least * F.greatest(F.size("sketch"), F.size("other"))  # cheap, and most pairs end here
    likely = cut_lineage(both.where(possible).where(F.size(F.array_intersect(union, common)) >= least * F.size(union))
                         .select("a", "b", "text_a", "text_b"))
    wanted = likely.select(F.col("text_a").alias("text_hash")).unionByName(likely.select(F.col("text_b").alias("text_hash"))).distinct()
    whole = cut_lineage(texts.join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("t").alias("t")).select(
        "text_hash", words(F.col("t")).alias("w")).select("text_hash", _windows(F.col("w")).alias("x")))
    exact = likely.join(whole.select(F.col("text_hash").alias("text_a"), "x"), "text_a").join(
        whole.select(F.col("text_hash").alias("text_b"), F.col("x").alias("y")), "text_b")
    shared = F.size(F.array_intersect("x", "y"))
    return exact.where(shared >= copy_share * (F.size("x") + F.size("y") - shared)).select("a", "b")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
           settings: RuleSettings = RuleSettings()) -> DataFrame:
    """One row per row of ``docs``: ``key``, the measures, ``base_failed``, ``removed_words``, ``kept``.

    Base rule: under 50 words, or more than half of the words in repeated three-word windows.  Line rule: normalised lines
    are hashed; for each host the distinct documents with a line are counted, where copies and near copies (``copies``)
    count as one.  Lines above the limits of ``settings`` are removed, and a document with
    less than ``kept_share`` of its words left is rejected.

    Null and blank texts have no words and fail the base rule.  A null host is a host of its own.  Repeated rows are judged
    alike, each with its own row; an empty table gives no rows; extra columns are ignored.
    """
    found = cut_lineage(measures(docs, key, text, host).withColumn("rid", F.monotonically_increasing_id()).withColumn(
        "hk", F.xxhash64(F.col("host").isNull(), F.coalesce("host", F.lit("")))))
    t = F.coalesce(F.col(text), F.lit(""))
    same = copies(found, docs.select(F.xxhash64(t).alias("text_hash"), t.alias("t")), settings.copy_share)
    per_line = found.select("rid", "hk", "text_hash", F.explode("lines").alias("line")).select(
        "rid", "hk", "text_hash", F.xxhash64("hk", "line.h").alias("k"), F.col("line.n").alias("n"))

    def document(texts: DataFrame) -> DataFrame:
        return texts.withColumn("node", document_node()).distinct().join(same, "node", "left").withColumn(
            "document", F.coalesce("component", "node"))

    sizes = document(found.select("hk", "text_hash")).groupBy("hk").agg(F.count_distinct("document").alias("documents"))
    # lines of enough texts first: no line has more documents than texts
    often = cut_lineage(per_line.groupBy("k").agg(F.count_distinct("text_hash").alias("texts"))
                        .where(F.col("texts") > settings.least_documents).select("k"))
    common = cut_lineage(
        document(per_line.join(often, "k", "left_semi").select("k", "hk", "text_hash")).groupBy("k").agg(
            F.count_distinct("document").alias("seen"), F.first("hk").alias("hk"))
        .where(F.col("seen") > settings.least_documents)
        .join(sizes, "hk").where(F.col("seen") > settings.share * F.col("documents")).select("k"))
    removed = per_line.join(common, "k", "left_semi").groupBy("rid").agg(F.sum("n").cast("long").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < settings.kept_share * F.col("n_words")
    return found.drop("lines", "sketch").join(removed, "rid", "left").fillna(0, ["removed_words"]).select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "removed_words", (~failed & ~depleted).alias("kept"), "host", "text_hash")


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
              settings: RuleSettings = RuleSettings()) -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged.

    Rejection depends on host and text only, so rejected rows are named by them, the text by its 64-bit hash, and taken out by an
    anti join.  Null and blank texts go, a null host is a host of its own, repeated rows stay or go together, an empty table stays
    empty, and other columns may have any names.
    """
    bad = cut_lineage(judged(docs, key, text, host, settings).where("not kept").select(
        F.coalesce("host", F.lit("")).alias("_h"), F.col("host").isNull().alias("_n"), F.col("text_hash").alias("_x")).distinct())
    t = F.coalesce(docs[text], F.lit(""))
    same = ((F.coalesce(docs[host].cast("string"), F.lit("")) == bad["_h"]) & (docs[host].isNull() == bad["_n"])
            & (F.xxhash64(t) == bad["_x"]))
    return docs.join(bad, same, "left_anti")
