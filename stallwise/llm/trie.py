"""Prefix trie of conversations: containers of suffixes burst under trie heads, the rest are sorted and swept into nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage

NOBODY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: SHA-256 of the empty string


@dataclass(frozen=True)
class TrieSettings:
    """A container of more than ``container`` turns bursts, if it holds more than one sequence."""

    container: int = 100_000


def turn_key(role: Column, text: Column) -> Column:
    """Equal for turns with the same role and the same text; the length keeps ('a', 'bc') apart from ('ab', 'c')."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text))


def sequences(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): every conversation's turns in order, as turn keys and as UTF-8 lengths of their texts.

    A conversation's row holds some 40 bytes a turn, never its texts.  Turns come by number, null first, equal numbers by their key; a
    null role or text is empty; rows without a conversation are left out; repeated rows are turns of their own.
    """
    one = F.struct(F.col(turn).alias("turn"), turn_key(F.col(role), F.col(text)).alias("key"),
                   F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    ordered = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    return ordered.select("conv_id", F.col("all.key").alias("ids"), F.col("all.size").alias("sizes"))


def rebuilt(convs: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """Each conversation with its first turns taken from the first one of its run of ``every``.

    It takes crc32(decimal id) % ``modulus`` turns: those of conversation c - c % ``every``, as many as there are, then its own
    after as many of its own.
    """
    convs = cut_lineage(convs).withColumn("h", F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {modulus} as int)")).withColumn(
        "base", F.expr(f"conv_id - conv_id % {every}"))
    first = convs.select(F.col("conv_id").alias("base"), *[F.slice(c, 1, modulus - 1).alias(f"head_{c}") for c in ("ids", "sizes")])
    taken = lambda c, kind: F.expr(
        f"concat(slice(coalesce(head_{c}, cast(array() as array<{kind}>)), 1, h), slice({c}, h + 1, greatest(size({c}) - h, 0)))")
    return convs.join(first, "base", "left").select("conv_id", taken("ids", "string").alias("ids"), taken("sizes", "int").alias("sizes"))


def _name(ids: str = "ids") -> Column:
    """A sequence's name: SHA-256 of its turn keys, all of one length."""
    return F.sha2(F.array_join(ids, ""), 256)


def _ends(convs: DataFrame) -> DataFrame:
    """(ids, ends): SHA-256 of the conversations that are the same sequence, in rising order.

    Sequences are dealt over the tasks and sorted there; the hash is fed row by row, so a group of any size takes no memory.
    """
    named = convs.select(_name().alias("name"), "conv_id")

    def hashed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        open_name, digest = None, None
        for batch in batches:
            names, ends = [], []
            for name, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if name != open_name:
                    if digest:
                        names.append(open_name)
                        ends.append(digest.hexdigest())
                    open_name, digest = name, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ends, pa.string())], names=["name", "ends"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([open_name]), pa.array([digest.hexdigest()])], names=["name", "ends"])

    return named.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(hashed, "name string, ends string")


def swept(rows: list[tuple], depth: int, parent: int | None):
    """Nodes of one container: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends), the top one last.

    ``rows``: (ids, sizes, least, n, ends) of distinct sequences that share their first ``depth`` turns.  In sorted order a node
    opens when a sequence leaves its predecessor's path and closes when one leaves its own.
    """
    rows.sort(key=lambda r: r[0])
    path: list[list] = []  # open nodes from the top: [least, n, children, leaves, saved, ends, bytes]
    before: list[str] = []

    def closed():
        node = path.pop()
        node[3] = node[3] or 1
        node[4] += (node[1] - 1) * node[6]
        if path:
            above = path[-1]
            above[0] = min(above[0], node[0])
            above[1] += node[1]
            above[2] += 1
            above[3] += node[3]
            above[4] += node[4]
        return [node[0], depth + len(path), None, node[1], node[2], node[3], node[4], node[5]]

    waiting: list[list[list]] = [[]]  # closed nodes by depth, until their parent is known
    out = []

    def close():
        node = closed()
        level = len(path)
        for child in waiting[level + 1] if len(waiting) > level + 1 else ():
            child[2] = node[0]
            out.append(child)
        del waiting[level + 1:]
        while len(waiting) <= level:
            waiting.append([])
        waiting[level].append(node)

    for ids, sizes, least, n, ends in rows:
        turns, shared = len(sizes), depth
        if path:
            limit = min(len(before), len(ids))
            while shared < limit and ids[shared] == before[shared]:
                shared += 1
            while depth + len(path) - 1 > shared:
                close()
        while depth + len(path) - 1 < turns:
            at = depth + len(path)
            path.append([least, 0, 0, 0, 0, NOBODY, sizes[at - 1] if at else 0])
        last = path[-1]
        last[0], last[1], last[5] = min(last[0], least), n, ends
        before = ids
    while path:
        close()
    top = waiting[0][0]
    top[2] = parent
    out.append(top)
    return out


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")


def nodes(convs: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """One row per node of the trie over (conv_id, ids, sizes): see ``prefix_trie``.

    Equal sequences become one with a number of members.  All start in one container below the root.  A container that is too full
    bursts: its head takes the turns that all of it shares (the common prefix of its smallest and its largest sequence), and its
    sequences move to one container per next turn.  What ends right there, ends at the head.  Then every container is sorted and
    swept in a task of its own, and what their tops report is added up along the heads, round by round.
    """
    convs = cut_lineage(convs)
    ends = _ends(convs)
    same = convs.withColumn("name", _name()).groupBy("name").agg(
        F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"))
    start = cut_lineage(same.join(ends, "name").select(
        "ids", "sizes", "least", "n", "ends", F.lit("").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"),
        F.lit(None).cast("string").alias("above")))
    # a container: head (the hash of its shared prefix), depth of its top, conv_id of the node above, head above
    open_rows, settled, bursts = start, [], []
    while True:
        state = cut_lineage(open_rows.groupBy("head").agg(
            F.sum(F.size("sizes") - F.col("depth") + 1).alias("turns"), F.count(F.lit(1)).alias("sequences"),
            F.min(F.struct("ids", "sizes")).alias("low"), F.max("ids").alias("high"), F.min("least").alias("top"),
            F.sum("n").alias("members"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("above").alias("above"))
            .where((F.col("turns") > settings.container) & (F.col("sequences") > 1)))
        if state.isEmpty():
            settled.append(open_rows)
            break
        settled.append(open_rows.join(state.select("head"), "head", "left_anti").select(*open_rows.columns))
        # what the smallest and the largest sequence share, all share
        state = cut_lineage(state.withColumn(
            "fork", F.expr("cast(array_position(zip_with(low.ids, high, (a, b) -> a <=> b), false) - 1 as int)")).select(
            "head", "depth", "parent", "above", "top", "members", "fork",
            F.expr("slice(concat(array(0), low.sizes), depth + 1, fork - depth + 1)").alias("chain")))
        split = open_rows.drop("depth", "parent", "above").join(state.select("head", "fork", "top"), "head")
        longer = F.size("sizes") > F.col("fork")
        bursts.append((state, cut_lineage(split.where(~longer).select("head", "ends", "n"))))
        open_rows = cut_lineage(split.where(longer).select(
            "ids", "sizes", "least", "n", "ends", F.sha2(F.array_join(F.expr("slice(ids, 1, fork + 1)"), ""), 256).alias("head"),
            (F.col("fork") + 1).alias("depth"), F.col("top").alias("parent"), F.col("head").alias("above")))

    columns = [c.split()[0] for c in NODE.split(", ")]

    def sweep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
        place, rows = None, []

        def finished() -> list[tuple]:
            head, depth, parent, above = place
            found = swept(rows, depth, parent)
            return [(head, above, i + 1 == len(found), *node) for i, node in enumerate(found)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["head", "above", "is_top", *columns])

        for batch in batches:
            out = []
            for *here, ids, sizes, least, n, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if place and here[0] != place[0]:
                    out += finished()
                    rows = []
                place = here
                rows.append((ids, sizes, least, n, ends))
            if out:
                yield batch_of(out)
        if rows:
            yield batch_of(finished())

    containers = settled[0]
    for s in settled[1:]:
        containers = containers.unionByName(s)
    arrow_rows(convs.sparkSession, 1024)
    made = cut_lineage(containers.select("head", "depth", "parent", "above", "ids", "sizes", "least", "n", "ends").repartition("head")
                       .sortWithinPartitions("head").mapInArrow(sweep, f"head string, above string, is_top boolean, {NODE}"))
    out, tops = made.select(*columns), made.where("is_top").select("head", "above", "n_leaves", "saved_tokens")
    for state, stopped in reversed(bursts):
        below = tops.groupBy(F.col("above").alias("head")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        # the chain of a head: its turns from the container's top to the fork, all with the same members
        heads = cut_lineage(state.join(below, "head").join(stopped.select("head", "ends"), "head", "left"))
        deeper = Window.partitionBy("head").orderBy(F.desc("at"))
        chain = heads.select("*", F.posexplode("chain").alias("step", "size")).withColumn("at", F.col("depth") + F.col("step")).withColumn(
            "saved_tokens", F.col("below") + (F.col("members") - 1) * F.sum("size").over(deeper))
        at_top, at_fork = F.col("at") == F.col("depth"), F.col("at") == F.col("fork")
        chain = chain.select(
            F.col("top").alias("conv_id"), F.col("at").cast("long").alias("depth"),
            F.when(at_top, F.col("parent")).otherwise(F.col("top")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
            F.when(at_fork, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", "saved_tokens",
            F.when(at_fork, F.coalesce("ends", F.lit(NOBODY))).otherwise(NOBODY).alias("ends_sha256"), "head", "above", at_top.alias("is_top"))
        chain = cut_lineage(chain)
        out = out.unionByName(chain.select(*out.columns))
        tops = tops.unionByName(chain.where("is_top").select("head", "above", "n_leaves", "saved_tokens"))
    return out


def prefix_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                settings: TrieSettings = TrieSettings()) -> DataFrame:
    """The trie of the conversations as they are: one row per distinct sequence of first turns, from the textless root on.

    (conv_id: smallest conversation that starts so, depth, parent_conv_id: the parent's conv_id, null for the root, n_convs, n_children,
    n_leaves: childless nodes in the subtree, saved_tokens: sum over the subtree of (n_convs - 1) times the bytes of a node's last
    text, ends_sha256: SHA-256 of the ids, comma-joined, of the conversations that end here, of the empty string if none.)

    Turns come by number, null first, equal numbers by role and text in the order of their hashes.  A null role or text is empty.  Rows
    without a conversation are left out; repeated rows are turns of their own.  An empty table has no nodes, not even a root.  Other
    columns are ignored, whatever their names.  One conversation's turn keys (not its texts) are held in one task.
    """
    return nodes(sequences(turns, key, turn, role, text), settings)
