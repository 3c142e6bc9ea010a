"""Benchmark decontamination: containment search with MinHash over size partitions, verified by exact containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventide.llm.common import materialize, shingles, slices, tidy, utf8, word_hashes

HASHES = 32
#: Items of a partition have between the largest size / RATIO and the largest size.
RATIO = 1.5
#: Items of so few shingles are looked up by each of them: a window of theirs would be shorter than the steps that windows are cut in.
FEW = 8
#: Shingles in the finest block whose minima are kept.
FINE = 4
#: Test items are broadcast in portions of at most so many characters; each portion is one pass over the documents.
PORTION = 32_000_000
AT_ONCE = 1_000_000
TOP = np.uint64(2**64 - 1)
_rng = np.random.default_rng(11)
XOR, ODD = _rng.integers(0, 2**64, HASHES, np.uint64), _rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def _grams(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, shingles and shingles before each row of portions of the texts."""
    data, offsets = utf8(column)
    for a, b in slices(offsets, AT_ONCE):
        own = offsets[a : b + 1]
        words, _, _, first = word_hashes(data[own[0] : own[-1]], own - own[0], True)
        yield a, *shingles(words, first, size)


class Index:
    """The items in partitions of like sizes, with each item's minimum under each hash."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        sizes = np.array([len(s) for s in sets], np.int64)
        self.parts: list[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        few = np.flatnonzero(sizes <= FEW)
        keys = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in few)])
        order = np.argsort(keys, kind="stable")
        self.few_keys, self.few_items = keys[order], np.repeat(few, sizes[few])[order]
        left = np.argsort(-sizes, kind="stable")
        left = left[sizes[left] > FEW]
        while len(left):
            top = int(sizes[left[0]])
            own = left[sizes[left] * RATIO >= top]
            left = left[len(own) :]
            by_hash = []
            for x, m in zip(XOR, ODD, strict=True):
                low = np.array([((sets[i] ^ x) * m).min() for i in own], np.uint64)
                order = np.argsort(low, kind="stable")
                near = np.zeros(1 << 16, bool)
                near[(low & np.uint64(0xFFFF)).astype(np.int64)] = True
                by_hash.append((low[order], own[order], near))
            self.parts.append((top, by_hash))

    def candidates(self, grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, item) that have a minimum in common: an item's, and that of a window of the row; of the shortest items any shingle.

        Windows are cut for each partition so that every run of as many shingles as its largest item lies in one.
        """
        count = np.diff(first)
        blocks = -(-count // FINE)
        at = np.concatenate([[0], np.cumsum(blocks)])
        if not at[-1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(count)), blocks)
        inner = np.arange(at[-1]) - np.repeat(at[:-1], blocks)
        starts = first[:-1][doc] + inner * FINE
        rows, items = [], []
        plans = []
        for top, by_hash in self.parts:
            step = max(1, top // (3 * FINE))
            heads = np.flatnonzero(inner % step == 0)
            more = -(-top // (FINE * step))
            after = [np.concatenate([doc[heads[t:]] == doc[heads[:-t]], np.zeros(min(t, len(heads)), bool)]) for t in range(1, more + 1)]
            plans.append((by_hash, heads, after))
        for j, (x, m) in enumerate(zip(XOR, ODD, strict=True)):
            fine = np.minimum.reduceat((grams ^ x) * m, starts)
            for by_hash, heads, after in plans:
                low, which, near = by_hash[j]
                wide = np.minimum.reduceat(fine, heads)
                window = wide.copy()
                for t, same in enumerate(after, 1):
                    if t < len(wide):
                        window[:-t] = np.where(same[:-t], np.minimum(window[:-t], wide[t:]), window[:-t])
                hit = np.flatnonzero(near[(window & np.uint64(0xFFFF)).astype(np.int64)])
                if len(hit):
                    a, b = np.searchsorted(low, window[hit], "left"), np.searchsorted(low, window[hit], "right")
                    times = b - a
                    place = np.repeat(a - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                    rows.append(np.repeat(doc[heads[hit]], times)), items.append(which[place])
        if len(self.few_keys):
            a, b = np.searchsorted(self.few_keys, grams, "left"), np.searchsorted(self.few_keys, grams, "right")
            times = b - a
            place = np.repeat(a - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            rows.append(np.repeat(np.repeat(np.arange(len(count)), count), times)), items.append(self.few_items[place])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _items(rows: list, size: int) -> Index:
    column = pa.array([r["text"] for r in rows], pa.string())
    ids, sets = [], []
    for a, grams, first in _grams(column, size):
        for k in range(len(first) - 1):
            if first[k + 1] > first[k]:
                ids.append(rows[a + k]["id"]), sets.append(np.unique(grams[first[k] : first[k + 1]]))
    return Index(ids, sets)


def contained(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc id, item id, shared, item_shingles, containment: the items of which a row holds `percent` hundredths or more.

    An item's or a row's shingles are its distinct runs of `size` words, A-Z as a-z, of the whole text; with fewer
    words, the whole sequence; texts without words have none and match nothing. Items of like sizes form a partition,
    for which each row is cut into overlapping windows of that size, so that short items stand out in long rows: an
    item is a candidate if one of 32 minima of its shingles is also a window's. Each candidate's containment is
    then counted on all shingles. Items of up to FEW shingles are candidates by any of their shingles, so none is missed;
    of the others, the tests and the README say how many are. Items are broadcast in portions of bounded size, one after
    the other, each a pass without a shuffle. Repeated rows give their own
    pairs, repeated items count once; null texts match nothing; null ids are kept; empty tables give an empty one.
    """
    spark = docs.sparkSession
    usable = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).dropna(subset=["text"]).distinct()
    length = usable.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    portions = length // PORTION + 1
    spec = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("item", items.schema[item_id].dataType), T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType())])
    kind = to_arrow_type(spec["item"].dataType)
    out = None
    for p in range(portions):
        part = usable if portions == 1 else usable.filter(F.pmod(F.xxhash64("id", "text"), F.lit(portions)) == p)
        shared = spark.sparkContext.broadcast(_items(part.collect(), size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows: list[int] = []
                found: list[list] = [[], [], []]
                for a, grams, first in _grams(b.column(1), size):
                    for d, i in zip(*(x.tolist() for x in index.candidates(grams, first)), strict=True):
                        want = index.sets[i]
                        n = int(np.isin(want, grams[first[d] : first[d + 1]]).sum())
                        if 100 * n >= percent * len(want):
                            rows.append(a + d), found[0].append(index.ids[i]), found[1].append(n), found[2].append(len(want))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found[0], kind), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["doc", "item", "shared", "item_shingles"])

        one = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(tidy(run), spec)
        if portions > 1:
            one = materialize(one, "contained")
            shared.unpersist()
        out = one if out is None else out.union(one)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows, with all columns, that hold no item. A row with a null id stays."""
    bad = materialize(contained(docs, items, text_col=text_col, id_col=id_col, **how).select(F.col(id_col).alias("_bad")).dropna().distinct(), "contaminated")
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")
