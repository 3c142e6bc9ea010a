"""Byte-level BPE on batches of distinct pre-tokens: counting on ragged arrays, encoding on padded matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventide.llm.common import slices, tidy, utf8

NONE = np.int32(2**31 - 1)
#: Entries of a worker's table of pre-tokens seen; it is emptied when full, which changes no result.
REMEMBERED = 150_000
#: Bytes of text handled at a time.
AT_ONCE = 1_000_000


class PairTable:
    """Pairs of symbols -> (rank, merged symbol), in an open-addressing table that is probed a whole array at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            _, one = np.unique(slot[free], return_index=True)  # one newcomer to each free slot
            placed = free[one]
            self.keys[slot[placed]] = keys[placed]
            self.rank[slot[placed]] = rank[placed]
            self.merged[slot[placed]] = merged[placed]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty slot, whose rank is NONE, for pairs that do not merge. Negative symbols never do."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = self.keys[slot[todo]]
            todo = todo[(at != keys[todo]) & (at != -1)]
        return slot


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabulary files use for each byte: itself where printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts the symbols that a tokenizer file's merges leave of each pre-token."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        ids = {k: np.array([vocab[p[k]] for p in pairs], np.int32) for k in (0, 1)}
        self.table = PairTable(ids[0], ids[1], np.arange(len(pairs), dtype=np.int32), np.array([vocab[a + b] for a, b in pairs], np.int32))
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], np.int32)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.seen: dict[str, int] = {}

    def surviving(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token. All are held end to end; in a round each merges its lowest-ranked pair wherever it has it."""
        lengths = np.array([len(p) for p in pretokens], np.int64)
        left = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        while len(symbols) > 1:
            slot = self.table.find(symbols[:-1], symbols[1:])
            rank = np.where(owner[:-1] == owner[1:], self.table.rank[slot], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            here = (rank == np.repeat(lowest, sizes)) & (rank != NONE)
            # of overlapping places (x x x) every second one, from the left
            run = np.maximum.accumulate(np.where(here & ~np.r_[False, here[:-1]], np.arange(len(here)), 0))
            here &= (np.arange(len(here)) - run) % 2 == 0
            at = np.flatnonzero(here)
            symbols[at] = self.table.merged[slot[at]]
            left -= np.bincount(owner[at], minlength=len(left))
            keep = np.repeat(lowest != NONE, sizes)  # finished ones leave the arrays
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return left

    def count(self, texts: list[str]) -> list[int]:
        out, split = [], []
        for text in texts:
            parts = self.split.split(text) if self.split else [text]
            out.append(len(parts) // 2)
            found: list[str] = []
            for part in parts[::2]:
                found += self.pattern.findall(part)
            split.append(found)
        new = set().union(*split) - self.seen.keys()
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {}
            new = set().union(*split)
        news = list(new)
        self.seen.update(zip(news, self.surviving([t.encode() for t in news]).tolist(), strict=True))
        return [n + sum(map(self.seen.__getitem__, found)) for n, found in zip(out, split, strict=True)]


class RankEncoder:
    """Encodes by a rank file: each pre-token is a row of a padded matrix, with rows of like lengths together."""

    #: Rows longer than this are merged with a heap, one at a time.
    WIDEST = 256

    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.token = {v: k for k, v in self.ranks.items()}
        a, b, r = [], [], []
        for whole, rank in self.ranks.items():
            for k in range(1, len(whole)):
                x, y = self.ranks.get(whole[:k]), self.ranks.get(whole[k:])
                if x is not None and y is not None:
                    a.append(x), b.append(y), r.append(rank)
        rank = np.array(r, np.int32)
        self.table = PairTable(np.array(a, np.int32), np.array(b, np.int32), rank, rank)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.seen: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table.rank[self.table.find(a, b)]

    def matrix(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of rows of like lengths. Each round, every row merges its leftmost lowest-ranked pair and closes the gap."""
        lengths = np.array([len(r) for r in rows])
        wide = int(lengths.max())
        out: list[list[int]] = [[]] * len(rows)
        ids = np.full((len(rows), wide + 2), -1, np.int32)  # the padding lets each row close a gap at its end
        ids[np.arange(wide + 2) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full_like(ids, NONE)
        rank[:, :-1] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), wide + 1)
        which = np.arange(len(rows))
        while len(which):
            at = rank.argmin(1)
            low = rank[np.arange(len(which)), at]
            done = low == NONE
            if done.any():
                for k, row in zip(which[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = row[: row.index(-1)]
                live = ~done
                which, ids, rank, at, low = which[live], ids[live], rank[live], at[live], low[live]
                if not len(which):
                    break
            me = np.arange(len(which))
            ids[me, at] = low  # a token's id is its rank
            stay = np.ones(ids.shape, bool)
            stay[me, at + 1] = False  # each row closes one gap
            ids, rank = ids[stay].reshape(len(me), -1), rank[stay].reshape(len(me), -1)
            rank[me, at] = self._rank(low, ids[me, at + 1])
            has = at > 0
            rank[me[has], at[has] - 1] = self._rank(ids[me[has], at[has] - 1], ids[me[has], at[has]])
        return out

    def long_row(self, row: bytes) -> list[int]:
        """The same merges for one very long pre-token, with a heap of (rank, place)."""
        ids = self.of_byte[np.frombuffer(row, np.uint8)].tolist()
        n = len(ids)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self._rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                y = nxt[x] if x >= 0 else n
                if y < n and (s := self.ranks.get(self.token[ids[x]] + self.token[ids[y]])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [ids[i] for i in range(n) if alive[i]]

    def encode_pretokens(self, pretokens: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pretokens)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pretokens):
            if p in self.ranks:
                out[k] = [self.ranks[p]]
            elif len(p) > self.WIDEST:
                out[k] = self.long_row(p)
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(k)
        for width, members in buckets.items():
            step = max(1, 400_000 // (4 * width))
            for s in range(0, len(members), step):
                part = members[s : s + step]
                for k, ids in zip(part, self.matrix([pretokens[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, in decimal and joined by a space, and what those ids decode to."""
        split = [self.pattern.findall(t) for t in texts]
        new = set().union(*split) - self.seen.keys()
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen, self.back = {}, {}
            new = set().union(*split)
        news = list(new)
        for t, ids in zip(news, self.encode_pretokens([t.encode() for t in news]), strict=True):
            self.seen[t] = key = " ".join(map(str, ids))
            self.back[key] = b"".join(self.token[i] for i in ids)
        out = []
        for found in split:
            keys = list(map(self.seen.__getitem__, found))
            out.append((" ".join(keys), b"".join(map(self.back.__getitem__, keys))))
        return out


ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_loaded: dict[tuple[type, str], MergeCounter | RankEncoder] = {}


def loaded(kind: type, path: str):
    """One of each for a worker process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _per_text(df: DataFrame, text_col: str, id_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list[tuple]]]) -> DataFrame:
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for first, last in slices(utf8(batch.column(1))[1], AT_ONCE):
                part = batch.slice(first, last - first)
                rows = work([t or "" for t in part.column(1).to_pylist()])
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, ARROW[f.dataType.typeName()]) for c, f in zip(cols, fields, strict=True))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(tidy(run), schema)


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row, by the merges of a byte-level tokenizer file (.json).

    Rank-synchronous merging on ragged arrays of the distinct pre-tokens of a portion of text. No shuffle.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows and ids give a row each; other columns are left out;
    an empty table gives an empty one. The file's added tokens count as one where they stand in a text.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make():
        counter = loaded(MergeCounter, tokenizer)
        return lambda texts: [(len(t.encode()), n, n > limit) for t, n in zip(texts, counter.count(texts), strict=True)]

    return _per_text(df, text_col, id_col, fields, make)


def encode(df: DataFrame, ranks: str, text_col: str = "text", id_col: str = "doc_id", keep: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids (decimal, joined by a space) and decoded bytes.

    Each pre-token is a row of a padded matrix that merges its leftmost lowest-ranked pair each round. No shuffle.
    A null or empty text has 0 tokens and empty ids. Repeated rows and ids give a row each; other columns are left
    out; an empty table gives an empty one.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep:
        fields += [T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())]

    def make():
        encoder = loaded(RankEncoder, ranks)

        def work(texts: list[str]) -> list[tuple]:
            rows = []
            for ids, back in encoder.encode(texts):
                row = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                rows.append(row + ((ids, back) if keep else ()))
            return rows

        return work

    return _per_text(df, text_col, id_col, fields, make)
