"""Conversation prefix trie from mergeable partial tries.

A sequence's prefixes are named by running sums of hashes of (place, role, text), so that a prefix's parent is known
where it stands, and a long conversation can be summed in several blocks at once. Each task emits the node table of its
own sequences, locally combined; tables of the same nodes are merged by key in two steps, which add up members; end
lists are merged by key and range of ids. What hangs below a node is rolled up from the bottom by doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import clean_text, materialize, tidy

WORD = r"[^\x20\x09-\x0D]+"
#: Every so many ids have one template, whose first turns the others take; a conversation takes fewer than so many of them.
FAMILY, MOST_SHARED = 20, 4
#: Groups in which the tables of tasks are merged before the last merge.
FAN_IN = 64
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["ka", "kb"]


def _running(df: DataFrame, order: list[str], kept: list[str], sums: list[str], label: str) -> DataFrame:
    """conv, kept, seen (rows of the conv before), sums (64-bit, with wraparound, up to the row), block: rows in order of conv and `order`.

    Rows are dealt by ranges, so a conversation of any length is spread over blocks. Each block counts for itself; what
    came before is added from the blocks' totals for their first and last conversation, two rows a block.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.repartitionByRange(parts, "conv", *order).sortWithinPartitions("conv", *order).select("conv", *kept, *sums)
    names = ["conv", *kept, "seen", *sums, "block", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        first = last = None  # conversation, and its sums so far
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            lengths = np.diff(np.append(starts, len(conv)))
            out = []
            for k, x in enumerate([np.ones(len(conv), np.uint64), *(b.column(1 + len(kept) + i).to_numpy().view(np.uint64) for i in range(len(sums)))]):
                total = np.cumsum(x)
                before = np.where(starts > 0, total[starts - 1], np.uint64(0))
                if last and conv[0] == last[0]:
                    before[:1] -= last[1][k : k + 1]
                out.append(total - np.repeat(before, lengths))
            if first is None or conv[0] == first[0]:
                first = int(conv[0]), np.array([x[lengths[0] - 1] for x in out])
            last = int(conv[-1]), np.array([x[-1] for x in out])
            seen = (out[0] - np.uint64(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(kept)], pa.array(seen), *(pa.array(x.view(np.int64)) for x in out[1:]), pa.array(np.full(len(conv), block, np.int32)), pa.array(np.zeros(len(conv), bool))], names=names)
        if last:
            totals = [first, last] if first[0] != last[0] else [last]
            found = [pa.array(np.array([t[1][k] for t in totals], np.uint64).view(np.int64)) for k in range(len(sums) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in totals]), *(pa.nulls(len(totals), pa.int64()) for _ in kept), *found, pa.array([block] * len(totals), pa.int32()), pa.array([True] * len(totals))], names=names)

    rows = materialize(dealt.mapInArrow(tidy(run), ", ".join([*(f"{c} long" for c in names[:-2]), "block int", "total boolean"])), label)
    found: dict[int, list] = {}
    for r in rows.filter("total").select("conv", "block", "seen", *sums).collect():  # two a block at most
        found.setdefault(r["conv"], []).append(tuple(r)[1:])
    before = []
    for conv, blocks in found.items():
        sofar = [0] * (len(sums) + 1)
        for k, (block, *values) in enumerate(sorted(blocks)):
            if k:
                before.append((conv, block, *sofar))
            sofar = [(s + v + 2**63) % 2**64 - 2**63 for s, v in zip(sofar, values, strict=True)]
    rows = rows.filter("NOT total").drop("total")
    if not before:
        return rows
    spans = spark.createDataFrame(before, ", ".join(["conv long", "block int", *(f"{c}_before long" for c in ("seen", *sums))]))
    rows = rows.join(F.broadcast(spans), ["conv", "block"], "left")  # one row a block at most
    for c in ("seen", *sums):
        rows = rows.withColumn(c, _wrapped(F.col(c), F.coalesce(f"{c}_before", F.lit(0).cast("long")))).drop(f"{c}_before")
    return rows


def _wrapped(a: Column, b: Column) -> Column:
    """a + b modulo 2**64."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    lower = low(a) + low(b)
    upper = low(F.shiftrightunsigned(a, 32)) + low(F.shiftrightunsigned(b, 32)) + F.shiftrightunsigned(lower, 32)
    return F.shiftleft(low(upper), 32).bitwiseOR(low(lower))


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), a, b (hashes of role and text), words: every turn in its place.

    Turns go by number, null first; ties by role, then text. Null roles and texts are empty; rows without an id are in
    no conversation and left out, as are other columns; repeated rows are turns of their own.
    """
    role, text = clean_text(role_col), clean_text(text_col)
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "text", "role"), "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    return _running(rows, ["turn", "role", "text"], ["a", "b", "words"], [], "turns").withColumnRenamed("seen", "pos").select("conv", "pos", "a", "b", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, length, pos, a, b, words) and conversations (conv, length) in which relatives share their first turns.

    Conversation c has the first h turns of conversation c - c % 20 (all if that has fewer, none if it is absent), then
    its own turns after its first h; h is the unsigned crc32 of c in decimal, modulo 4. Some are left without turns.
    """
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    shared = F.crc32(F.col("conv").cast("string")) % MOST_SHARED
    templates = lengths.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("template"), F.col("n").alias("of_template"))
    convs = lengths.withColumn("h", shared).withColumn("template", F.col("conv") - F.col("conv") % FAMILY).join(templates, "template", "left")
    convs = materialize(convs.withColumn("taken", F.least("h", F.coalesce("of_template", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).select(F.col("conv").alias("template"), "pos", "a", "b", "words")
    first = heads.join(convs.select("conv", "template", "h", "length"), "template").filter("pos < h").select("conv", "length", "pos", "a", "b", "words")
    own = turns.withColumn("h", shared).filter("pos >= h").join(convs.select("conv", "taken", "length"), "conv")
    own = own.select("conv", "length", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "words")
    return first.union(own), convs.select("conv", "length")


def _tables(paths: DataFrame) -> DataFrame:
    """Node tables of each task's sequences, locally combined: ka, kb, depth, pa, pb (the parent's key), words, n, least, ended, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            conv, depth, ka, kb, above_a, above_b, words, end, block = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            by = np.lexsort((conv, kb, ka))
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(ka[by]) != 0) | (np.diff(kb[by]) != 0)]))
            one = by[starts]
            members = np.diff(np.append(starts, len(by)))
            columns = [ka[one], kb[one], depth[one], above_a[one], above_b[one], words[one], members, conv[one], np.logical_or.reduceat(end[by], starts), block[one]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["ka", "kb", "depth", "pa", "pb", "words", "n", "least", "ended", "block"])

    return paths.select("conv", "depth", "ka", "kb", "pa", "pb", "words", "end", "block").mapInArrow(tidy(run), "ka long, kb long, depth long, pa long, pb long, words long, n long, least long, ended boolean, block int")


def _end_hashes(paths: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256 of nodes at which sequences end.

    End lists are merged by key for each range of 65,536 ids, so that a list is bounded; a node's lists are hashed one
    after the other as they come sorted, as SHA-256 goes through its text in order.
    """
    lists = paths.filter("end").groupBy(*KEY, F.shiftright("conv", 16).alias("high")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []

        def done() -> pa.RecordBatch:
            a, b, text = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = ",".join(map(str, ids)).encode()
                if (a, b) == node:
                    sha.update(b"," + text)
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (a, b), hashlib.sha256(text)
            yield done()
        if node:
            out.append((*node, sha.hexdigest()))
        yield done()

    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "high").select(*KEY, "ids").mapInArrow(tidy(run), "ka long, kb long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences: turns (conv, length, pos, a, b, words), conversations (conv, length).

    A node for each distinct sequence of first turns, from the textless root: conv_id (its smallest member), depth,
    parent_conv_id (null for the root), n_convs (members), n_children, n_leaves, saved_tokens (over its subtree, words
    of the last turn times members but one) and ends_sha256 (of the ids that end there, ascending, comma-joined). No
    conversations, no nodes. Nodes with one member need no roll-up: they have one leaf below them and save nothing.
    """
    salted = turns.select("conv", "length", F.col("pos").cast("long").alias("pos"), "words", F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64(F.lit(2), "b", "a", "pos").alias("y"))
    roots = convs.select("conv", "length", *(F.lit(v).cast("long") for v in (-1, 0, 0, 0)))
    rows = salted.union(roots).withColumns({"ka": F.col("x"), "kb": F.col("y")})
    paths = _running(rows, ["pos"], ["length", "pos", "words", "x", "y"], KEY, "trie-paths")
    minus = lambda k, v: _wrapped(F.col(k), _wrapped(F.bitwise_not(F.col(v)), F.lit(1).cast("long")))
    paths = paths.withColumns({"depth": F.col("pos") + 1, "pa": minus("ka", "x"), "pb": minus("kb", "y"), "end": F.col("pos") + 1 == F.col("length")})
    merging = [F.first("depth").alias("depth"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("words").alias("words"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("ended").alias("ended")]
    merged = _tables(paths).groupBy(*KEY, (F.col("block") % FAN_IN).alias("part")).agg(*merging).groupBy(*KEY).agg(*merging)
    nodes = materialize(merged, "trie-nodes")

    below = nodes.filter("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("n") == 1).alias("single"))
    shared = nodes.filter("n > 1").join(below, KEY, "left").select(*KEY, "depth", "pa", "pb", "least", F.coalesce("children", F.lit(0)).alias("children"), (F.coalesce("single", F.lit(0)) + F.when(F.col("children").isNull(), 1).otherwise(0)).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    shared = _rolled_up(materialize(shared, "trie-shared"))
    parents = shared.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("least").alias("parent"))
    rolled = shared.select(*KEY, "children", "leaves", "saved")
    out = nodes.join(rolled, KEY, "left").join(_end_hashes(paths), KEY, "left").join(parents, ["pa", "pb"], "left")
    return out.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "least")).alias("parent_conv_id"),  # a parent with one member has the node's own
        F.col("n").alias("n_convs"),
        F.when(F.col("n") > 1, F.col("children")).otherwise(F.when(F.col("ended"), 0).otherwise(1)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """leaves and saved summed over each node's subtree. In a round each node gets what is below those 1, 2, 4, ... steps under it."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step, sums = 1, materialize(nodes.withColumns({"ua": F.col("pa"), "ub": F.col("pb")}), "trie-sums")  # ua, ub: the node that many steps above
    while step <= deepest:
        given = sums.filter(F.col("depth") >= step).groupBy(F.col("ua").alias("ka"), F.col("ub").alias("kb")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        added = sums.join(given, KEY, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).drop("more_leaves", "more_saved")
        if 2 * step <= deepest:
            above = sums.filter(F.col("depth") >= step).select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("ua").alias("va"), F.col("ub").alias("vb"))
            far = added.filter(F.col("depth") >= 2 * step).join(above, ["ua", "ub"]).withColumns({"ua": F.col("va"), "ub": F.col("vb")})
            added = added.filter(F.col("depth") < 2 * step).unionByName(far.drop("va", "vb"))
        sums = materialize(added, "trie-sums")
        step *= 2
    return sums


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of the conversations as they are; see ``sequences`` for odd rows and ``trie`` for the nodes."""
    turns = sequences(conversations, **columns)
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    return trie(turns.join(convs, "conv"), convs)
