"""Helpers that the training-data operators share: shared storage, UTF-8 buffers, word shingles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master that names none."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="eventide-"))
    return _own_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventide-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, what jobs send to Python comes in batches of `most` bytes; afterwards the session's own setting holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, had)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work; at a task's end, memory that its arrays no longer use goes back to the system, as Spark keeps Python workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it."""
    had = {c.lower() for c in df.columns}
    while name in had:
        name += "_"
    return name


def clean_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least: bounds the working arrays, drops nothing."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


#: Odd multipliers of the polynomial and finishing hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(32)
    x *= MIX
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of each word [^\\x20\\x09-\\x0D]+ and the words before each row. fold: A-Z as a-z."""
    if fold:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~space
    edge = word[1:] != word[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[0] = cut[-1] = False
    inside = cut & word[:-1] & word[1:]  # a row's end inside a run of letters ends a word and begins one
    starts = np.flatnonzero((edge & word[1:]) | inside)
    ends = np.flatnonzero((edge & word[:-1]) | inside)
    # The hash is a sum of byte * r**place; equal words have equal place-shifted sums after multiplying by r**-start.
    hashed = _span_hash(data, starts, ends)
    return hashed, starts, ends, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        m = 1 << max(16, int(n).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inverse)):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words that stays in its row, and the shingles before each row.

    A row of fewer words, but one at least, has its whole sequence as its only shingle.
    """
    n = len(words)
    per_row = np.diff(first)
    full = np.maximum(per_row - size + 1, 0)
    count = np.where(per_row > 0, np.maximum(full, 1), 0)
    out_first = np.concatenate([[0], np.cumsum(count)])
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], count)
    left = np.repeat(first[1:], count) - at  # words from here to the row's end
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = left > k
        w = words[np.minimum(at + k, n - 1)]
        out = np.where(here, mixed((out + np.uint64(k + 1)) * BASE ^ w), out)
    return out, out_first
