"""Repeated byte strings, marked with a run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Windows of `length` bytes are dealt out by their smallest k-gram hash, so that equal windows meet. What shares such a
hash is indexed in blocks of bounded size; every text of a block streams its matching statistics against the others,
and where those reach `length` a string repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import materialize, mixed, powers, prefix_sums, slices, tidy, utf8

LENGTH, GRAM = 200, 32
AT_ONCE = 2_000_000
#: Bytes of text in a block of the index.
BLOCK_BYTES = 1_000_000
#: More different pieces than this with one smallest hash are compared window by window, by Spark, not in one block.
BLOCK_PIECES = 2_000
TOP = np.uint64(2**64 - 1)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows whose smallest k-gram is the same occurrence: start, windows, hash of that k-gram, row.

    Two equal windows of any texts are in pieces of equal hash; in one text, never in the same piece.
    """
    n, w = len(data), length - k + 1
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    grams = np.full(n, TOP, np.uint64)
    grams[: n - k + 1] = mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])
    grid = np.concatenate([grams, np.full((-n) % w + w, TOP, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    at = np.arange(windows.sum()) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    row = np.repeat(np.arange(len(size)), windows)
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | (grams[at[:-1]] == low[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), low[first], row[first]


PIECE = "gram long, body long, key long, tag long, start int, windows int, times int"
PIECE_NAMES = ["gram", "body", "key", "tag", "start", "windows", "times"]


def _pieces(docs: DataFrame, length: int) -> DataFrame:
    """A row for each piece, or for each run of equal neighbouring pieces in a text (times): its k-gram, the hash of its bytes, where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            keys, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for x, y in slices(offsets, AT_ONCE):
                own = offsets[x : y + 1]
                part = np.ascontiguousarray(data[own[0] : own[-1]])
                start, windows, gram, row = pieces(part, own - own[0], length)
                view = memoryview(part)
                body = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)), np.uint64, len(start))
                new = np.ones(len(start), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (body[1:] != body[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(start)))
                start = start - (own - own[0])[row]
                cols = [gram[first].view(np.int64), body[first].view(np.int64), keys[row[first] + x], tags[row[first] + x], start[first].astype(np.int32), windows[first].astype(np.int32), times.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=PIECE_NAMES)

    return docs.select("key", "tag", "text").mapInArrow(tidy(run), PIECE)


class RunLengthIndex:
    """A block of texts: the runs of its Burrows-Wheeler transform, with a sample for each run's first and last symbol.

    A step from a row of the transform to the row of the text one symbol longer (LF) takes the row's run only: where the
    rows of the run's symbol go. The rows before and after go along as long as they are in the same run, so that what a
    row has in common with them grows by one; at a run's end it is another row that comes to stand there, and the
    sample says what they have in common. So all texts of the block are streamed at once, from their ends to their
    beginnings, and each place learns its longest match with any other. The suffix array itself is not kept.
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])
        body = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
        body[self.starts + self.sizes] = 0  # a separator, below every byte
        n, self.body = len(body), body
        self.n = n
        order, levels = self._suffixes(body)
        before = body[order - 1]  # before the whole stands the last separator
        head = np.append(0, np.flatnonzero(before[1:] != before[:-1]) + 1)
        self.run_start, self.run_symbol = head, before[head]
        self.run_length = np.diff(np.append(head, n))
        # where the first row of each run goes: after the rows of smaller symbols and of its own in earlier runs
        by = np.argsort(self.run_symbol, kind="stable")
        self.run_to = np.empty(len(head), np.int64)
        self.run_to[by] = np.cumsum(self.run_length[by]) - self.run_length[by]
        # separators alike are told apart by what follows them, as their rows are; so every step keeps the rows' order
        first, last = self.run_to, self.run_to + self.run_length - 1
        self.head_match, self.tail_match = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        self.head_match[first > 0] = self._match(levels, order[first[first > 0] - 1], order[first[first > 0]])
        self.tail_match[last < n - 1] = self._match(levels, order[last[last < n - 1]], order[last[last < n - 1] + 1])
        rows = np.empty(n, np.int64)
        rows[order] = np.arange(n)
        self.end_rows = rows[self.starts + self.sizes]
        del self.body

    @staticmethod
    def _suffixes(body: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The order of all suffixes, by doubling from 7 symbols; what is told apart already is not sorted again."""
        n, width = len(body), 7
        padded = np.concatenate([body, np.zeros(width, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = key << 9 | padded[k : k + n]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.full(n + 1, -1, np.int64)  # beyond the end: before all
        rank[order] = group
        levels = [(width, rank[:n].astype(np.int32))]
        while True:
            alone = fresh & np.append(fresh[1:], True)
            where = np.flatnonzero(~alone)
            if not len(where):
                return order, levels
            sub = order[where]
            key = rank[sub] * (n + 2) + rank[np.minimum(sub + width, n)] + 1
            by = np.argsort(key, kind="stable")
            sub, key = sub[by], key[by]
            order[where] = sub
            begins = np.concatenate([[True], key[1:] != key[:-1]])
            rank[sub] = np.maximum.accumulate(np.where(begins, where, 0))
            fresh[where] = begins
            width *= 2
            levels.append((width, rank[:n].astype(np.int32)))

    def _match(self, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        out = np.zeros(len(a), np.int64)
        for width, rank in reversed(levels):
            x, y = a + out, b + out
            inside = np.maximum(x, y) < self.n
            same = np.zeros(len(a), bool)
            same[inside] = rank[x[inside]] == rank[y[inside]]
            out += width * same
        going = np.ones(len(a), bool)
        for _ in range(levels[0][0] - 1):  # what is left of less than the first step
            x, y = a + out, b + out
            going &= np.maximum(x, y) < self.n
            going[going] = self.body[x[going]] == self.body[y[going]]
            out += going
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every place the length of its longest match with another place; one that reaches its text's end may count what follows."""
        best = np.zeros(self.n, np.int64)
        by = np.argsort(-self.sizes, kind="stable")  # the longest first: those that still go on stand in front
        row, at, left = self.end_rows[by], (self.starts + self.sizes)[by], self.sizes[by]
        above, below = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for step in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -step, "left"))  # texts longer than this
            row, at, above, below = row[:m], at[:m] - 1, above[:m], below[:m]
            run = np.searchsorted(self.run_start, row, "right") - 1
            inner = row - self.run_start[run]
            above = np.where(inner > 0, above + 1, self.head_match[run])
            below = np.where(inner < self.run_length[run] - 1, below + 1, self.tail_match[run])
            row = self.run_to[run] + inner
            best[at] = np.maximum(above, below)
        return best


def _gram_counts(docs: DataFrame, length: int) -> DataFrame:
    """gram, n: k-gram hashes of pieces with how many of a portion's pieces have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            for x, y in slices(offsets, AT_ONCE):
                own = offsets[x : y + 1]
                gram, n = np.unique(pieces(data[own[0] : own[-1]], own - own[0], length)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int32))], names=["gram", "n"])

    return docs.select("text").mapInArrow(tidy(run), "gram long, n int")


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, body, c, bytes of the wanted pieces, each cut from the one text that was noted for it."""
    lists = wanted.groupBy("key", "tag").agg(F.collect_list(F.struct("gram", "body", "c", "start", "windows")).alias("pieces"))  # bounded by one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, own in zip(b.column(0), b.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                got = own.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["gram"] for p in got], pa.int64()), pa.array([p["body"] for p in got], pa.int64()), pa.array([p["c"] for p in got], pa.int64()), pa.array([data[p["start"] : p["start"] + p["windows"] + length - 1] for p in got], pa.binary())],
                    names=["gram", "body", "c", "bytes"],
                )

    return docs.join(lists, ["key", "tag"]).select("text", "pieces").mapInArrow(tidy(run), "gram long, body long, c long, bytes binary")


SPANS = "gram long, body long, spans array<struct<a:int,b:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _indexed(contents: DataFrame, length: int) -> DataFrame:
    """gram, body, spans: what repeats of the pieces that stand once, by the run-length index of their block.

    A piece that stands several times is represented by one of its copies: it repeats as a whole, and the index holds it
    for what it shares with the others.
    """

    def block(held: dict[int, tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows = list(held.values())
        index = RunLengthIndex([t for _, _, t in rows])
        long_enough = np.concatenate([index.matching_statistics() >= length, [False]])
        out: list[list] = [[], [], []]
        for (gram, c, text), body, first in zip(rows, held, index.starts.tolist(), strict=True):
            if c > 1:
                continue
            here = np.zeros(len(text) - length + 3, np.int8)
            here[1:-1] = long_enough[first : first + len(text) - length + 1]
            edge = np.diff(here)
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + length - 1
            if len(a):
                out[0].append(gram), out[1].append(body), out[2].append([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _SPAN_ARROW)], names=["gram", "body", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int, bytes]] = {}
        size, last = 0, None
        for b in batches:
            for gram, body, c, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if size >= BLOCK_BYTES and gram != last:
                    yield block(held)
                    held, size = {}, 0
                last = gram
                if body not in held:
                    held[body] = gram, c, text
                    size += len(text)
        if held:
            yield block(held)

    return contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(tidy(run), SPANS)


def _windowed(contents: DataFrame, length: int) -> DataFrame:
    """The same for pieces of very frequent k-grams: every window by itself, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, body, c, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                n = len(text) - length + 1
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[k : k + length]) for k in range(n)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[::2]), pa.array(names[1::2]), pa.array(np.full(n, gram)), pa.array(np.full(n, body)), pa.array(np.full(n, c)), pa.array(np.arange(n, dtype=np.int32))], names=["w1", "w2", "gram", "body", "c", "a"])

    rows = materialize(contents.mapInArrow(tidy(run), "w1 long, w2 long, gram long, body long, c long, a int"), "windows")
    again = rows.select("w1", "w2", "gram", "body").distinct().groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = rows.filter("c = 1").join(again, ["w1", "w2"], "left_semi")
    return hits.groupBy("gram", "body").agg(F.sort_array(F.collect_set(F.struct("a", (F.col("a") + length).alias("b")))).alias("spans"))  # at most length - k + 1


def _marked(docs: DataFrame, length: int) -> DataFrame:
    """key, tag, spans: the bytes of each text (a to b, end exclusive) that repeated windows cover."""
    found = _pieces(docs, length)
    often = _gram_counts(docs, length).groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    found = materialize(found.join(often, "gram", "left_semi"), "pieces")
    one = found.groupBy("gram", "body").agg(F.sum("times").alias("c"), *(F.first(c).alias(c) for c in ("key", "tag", "start", "windows")))
    one = materialize(one, "bodies")
    kinds = one.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    shared = materialize(one.join(kinds, "gram"), "shared")
    spans = [_indexed(_contents(docs, shared.filter(F.col("kinds") <= BLOCK_PIECES), length), length)]
    hot = shared.filter(F.col("kinds") > BLOCK_PIECES)
    if not hot.isEmpty():
        spans.append(_windowed(_contents(docs, hot, length), length))
    part = materialize(spans[0] if len(spans) == 1 else spans[0].union(spans[1]), "spans")
    # pieces that stand several times repeat from end to end, and so do all of a run of equal neighbours
    whole = found.join(one.filter("c > 1").select("gram", "body"), ["gram", "body"], "left_semi").select("key", "tag", F.col("start").alias("a"), (F.col("start") + F.col("windows") * F.col("times") + length - 1).alias("b"))
    some = found.join(part, ["gram", "body"]).select("key", "tag", "start", F.explode("spans").alias("s")).select("key", "tag", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))
    return whole.union(some).groupBy("key", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # bounded by one text


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, keep: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep, spans and kept (the bytes that are left) of every row.

    Each byte goes that lies in a string of `length` bytes which also starts anywhere else in the UTF-8 of any row,
    the same one included; overlaps count, no string crosses rows, and all are judged on the input. n_spans are the
    maximal runs that go. A null or empty text has 0 bytes; texts shorter than `length` stay whole. Rows that are
    repeated remove each other; repeated or null ids give a row each; other columns are left out; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("id", F.xxhash64("id").alias("key"), F.xxhash64("text").alias("tag"), "text")
    marks = _marked(rows.select("key", "tag", "text"), length)
    both = rows.join(marks, ["key", "tag"], "left").select("id", "text", "spans")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["spans", "kept"] if keep else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                runs: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))
                for c, v in zip(out, (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"a": x, "b": y} for x, y in runs], kept), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPAN_ARROW, pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in list(zip(out, kinds, strict=True))[: len(names) - 1])], names=names)

    spec = f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<a:int,b:int>>, kept binary" if keep else "")
    return both.mapInArrow(tidy(run), spec).withColumnRenamed("id", id_col)
