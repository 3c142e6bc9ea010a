"""Quality classifier: hashed word and character n-gram vectors, averaged over a document and learned with its softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import BASE, mixed, slices, tidy, utf8, word_hashes

BITS, DIM = 18, 8
NGRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE = 6, 64, 0.5
#: At most so many labelled documents are learned from, the first by a hash of their id; training is one bounded task.
TRAINING_ROWS = 4000
#: Bytes of text whose features are held at a time.
AT_ONCE = 500_000
SPACES = np.frombuffer(bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256)), np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each document's features, documents end to end, and where each begins.

    A feature is a word, or a run of 3, 4 or 5 bytes (white space as one sort of byte). Every document has all of its
    own, and one that is always there.
    """
    n, rows = len(data), len(offsets) - 1
    buckets, docs = [np.zeros(rows, np.int32)], [np.arange(rows)]
    shift = np.uint64(64 - BITS)
    if n:
        owner = np.repeat(np.arange(rows), np.diff(offsets))
        plain = SPACES[data].astype(np.uint64) + np.uint64(1)
        gram = plain
        for k in range(1, max(NGRAMS)):
            if len(gram) < 2:
                break
            gram = gram[:-1] * BASE + plain[k:]
            if k + 1 in NGRAMS:
                m = len(gram)
                same = owner[:m] == owner[k:]
                buckets.append(((gram[same] + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int32)), docs.append(owner[:m][same])
        words, starts, _, first = word_hashes(data, offsets, False)
        at = np.repeat(np.arange(rows), np.diff(first))
        buckets.append((mixed(words) >> shift).astype(np.int32)), docs.append(at)
    size = sum(np.bincount(d, minlength=rows) for d in docs)
    order = np.argsort(np.concatenate(docs), kind="stable")
    return np.concatenate(buckets)[order], np.concatenate([[0], np.cumsum(size)])


class Model:
    """vectors: bucket -> vector; weights: the softmax over two labels. What scoring needs is one number a bucket."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = ((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
        self.weights = np.zeros((2, DIM), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
        """Stochastic gradient descent in batches, with a step for each parameter that its past gradients shorten."""
        docs = []  # each with its buckets, how often it has them (in the smallest fitting type), and the sum of that
        for t in texts:
            buckets, _ = features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            ids, times = np.unique(buckets, return_counts=True)
            docs.append((ids, times.astype(np.min_scalar_type(times.max())), times.sum()))
        seen = np.full(len(self.vectors), 1e-6, np.float32)
        seen_w, seen_b = np.full_like(self.weights, 1e-6), np.full_like(self.bias, 1e-6)
        rng, want = np.random.default_rng(seed), np.eye(2, dtype=np.float32)[labels.astype(int)]
        for _ in range(EPOCHS if docs else 0):
            order = rng.permutation(len(docs))
            for k in range(0, len(docs), BATCH):
                part = order[k : k + BATCH]
                ids = np.concatenate([docs[i][0] for i in part])
                share = np.concatenate([(docs[i][1] / docs[i][2]).astype(np.float32) for i in part])
                first = np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in part])[:-1]])
                mean = np.add.reduceat(self.vectors[ids] * share[:, None], first)
                said = mean @ self.weights.T + self.bias
                p = np.exp(said - said.max(1, keepdims=True))
                wrong = (p / p.sum(1, keepdims=True) - want[part]) / len(part)
                back = wrong @ self.weights
                gw, gb = wrong.T @ mean, wrong.sum(0)
                grad = np.repeat(back, np.diff(np.append(first, len(ids))), axis=0) * share[:, None]
                to, where = np.unique(ids, return_inverse=True)
                step = np.stack([np.bincount(where, grad[:, d], len(to)) for d in range(DIM)], 1).astype(np.float32)
                seen[to] += (step**2).mean(1)
                self.vectors[to] -= RATE * step / np.sqrt(seen[to])[:, None]
                seen_w += gw**2
                seen_b += gb**2
                self.weights -= RATE * gw / np.sqrt(seen_w)
                self.bias -= RATE * gb / np.sqrt(seen_b)
        return self

    def folded(self) -> np.ndarray:
        """For each bucket what it adds to label 1's lead over label 0; last the bias."""
        w = self.weights[1] - self.weights[0]
        return np.append(self.vectors @ w, self.bias[1] - self.bias[0]).astype(np.float32)


def scores(folded: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = []
    for a, b in slices(offsets, AT_ONCE):
        own = offsets[a : b + 1]
        buckets, first = features(data[own[0] : own[-1]], own - own[0])
        lead = np.add.reduceat(folded[buckets].astype(np.float64), first[:-1]) / np.diff(first) + folded[-1]
        out.append(1 / (1 + np.exp(-lead)))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of ids whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAINING_ROWS) -> np.ndarray:
    """The folded table of a model learned from at most `rows` labelled documents outside the held-out quarter.

    One task fits it. Labels that are null or not 0 or 1, or whose document is missing, teach nothing; without usable
    labels every score is 0.5.
    """
    usable = labels.select(id_col, F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.orderBy(F.xxhash64(id_col), id_col, "label").limit(rows)  # bounded: it may be broadcast
    sample = docs.select(F.col(id_col), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("body")).join(F.broadcast(chosen), id_col)
    # ids that repeat could make the sample longer than its bound
    sample = sample.orderBy(F.xxhash64(id_col), id_col, "body", "label").limit(rows).coalesce(1).select("body", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            label += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([Model().fit(texts, np.array(label)).folded().tobytes()], pa.binary())], names=["model"])

    got = sample.mapInArrow(tidy(fit), "model binary").collect()
    return np.frombuffer(got[0]["model"], np.float32) if got else Model().folded()


def classify(docs: DataFrame, folded: np.ndarray, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All rows and columns, with score (0 to 1, higher: label 1 likelier) and predicted (1 if the score reaches the threshold).

    Only the text decides. No shuffle. A null text is an empty one; an empty text has the score of the bias and of the
    feature that every document has. Repeated rows give a row each. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(folded)  # 2**18 + 1 numbers, whatever the input
    at = docs.columns.index(text_col)
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(shared.value, *utf8(b.column(at))), pa.float64())], names=names)

    spec = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(run), spec).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

