"""Texts cut into runs of wanted bytes, as Arrow strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from eventide.llm.common import slices, utf8

#: A-Z as a-z; all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+, and of terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+: ASCII letters and all of other characters' bytes.
WORD = np.ones(256, bool)
WORD[[32, *range(9, 14)]] = False
TERM = np.ones(256, bool)
TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def runs(column: pa.Array, wanted: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of wanted bytes of all rows, folded, one after the other, and how many come before each row (one more at the end)."""
    data, offsets = utf8(column)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = wanted[data]
    edge = inside[1:] != inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[1:-1]] = True
    cut[0] = cut[-1] = False
    cut &= inside[:-1] & inside[1:]  # a row's end inside a run ends one and begins the next
    starts = np.flatnonzero((edge & inside[1:]) | cut)
    ends = np.flatnonzero((edge & inside[:-1]) | cut)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    body = FOLD[data][inside[1:-1]]
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
    return found, np.searchsorted(starts, offsets)


def byte_slices(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least."""
    return list(slices(utf8(column)[1], most))
