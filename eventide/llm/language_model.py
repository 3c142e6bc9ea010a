"""Hashed maximum-entropy language model with class-factored softmax.

A word's class is a hash of its ending, its member number a hash of all of it. The model gives a class's probability
and, within the class, a member's, each by a softmax over sums of weights that hashed features of the context name:
the last word, the one before it and the one before that (skips), and the last two together. Words that share class and
member share its probability by their counts in the corpus, so that the probabilities of all words, one unknown word for
each class and member included, sum to one. Counts cover all training documents; so do the weights, which tasks train by
gradient steps on their own slices, in rounds, each starting from the average of the last round's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import arrow_batches, materialize, mixed, powers, prefix_sums, tidy
from eventide.llm.words import WORD, byte_slices, runs

#: Bytes of text in a slice, about; tokens in a gradient step; rounds, in each of which other slices are learned from.
SLICE, STEP, ROUNDS = 8_000_000, 8192, 3
#: Classes, members in each (as many), rows of hashed weights of either softmax.
CLASSES, CLASS_ROWS, MEMBER_ROWS = 32, 1 << 13, 1 << 15
ROWS = 1 + CLASSES + CLASS_ROWS + MEMBER_ROWS
RATE = 0.15
#: Sums of weights stay within this bound, far beyond what training reaches, so that exponentials do.
MOST = np.float32(80)
ONES = np.ones(CLASSES, np.float32)
#: Rows of equal keys that are summed at once; a matter of time only.
FEW = 8
#: Rows of weights that are averaged at a time.
BLOCK = 4096
SALTS = np.array([0x1F3B, 0x2A6D, 0x4E17], np.uint64) << np.uint64(40)
START = np.uint64(0x5851F42D4C957F2D)


def training(id_col: str = "doc_id") -> Column:
    """True where the model may learn from the row: all ids but the seventh part that is held out. Null ids are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True))


def _slices(docs: DataFrame) -> DataFrame:
    """Documents by slices: part, round, ids, held, lengths (tokens), codes of the tokens, dictionary (words, spaces between; code 0 is the end)."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for whole in batches:
            for first, last in byte_slices(whole.column(2), SLICE):
                b = whole.slice(first, last - first)
                found, at = runs(b.column(2), WORD)
                coded = found.dictionary_encode()
                lengths = np.diff(at) + 1
                codes = np.zeros(len(found) + b.num_rows, np.int32)
                inside = np.ones(len(codes), bool)
                inside[np.cumsum(lengths) - 1] = False
                codes[inside] = coded.indices.to_numpy() + 1
                body = zlib.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # equal high bytes stand together
                lists = [pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([b.column(1).to_pylist()], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64()))]
                bodies = [pa.array([x], pa.binary()) for x in (body, " ".join(coded.dictionary.to_pylist()).encode())]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + count]), pa.array([(task + count) % ROUNDS], pa.int32()), *lists, *bodies], names=["part", "round", "ids", "held", "lengths", "codes", "dictionary"])
                count += 1

    return docs.select("id", "held", "text").mapInArrow(tidy(run), f"part long, round int, ids array<{kind}>, held array<boolean>, lengths array<long>, codes binary, dictionary binary")


def _codes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _words(dictionary: bytes) -> list[str]:
    """The words by code; the end's is empty."""
    return ["", *dictionary.decode().split(" ")] if dictionary else [""]


def _body(dictionary: bytes) -> bytes:
    """The words by code with spaces between, as ``named`` takes them; the first is the end's."""
    return b" " + dictionary if dictionary else b""


def named(words: list[str] | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class and member of words."""
    body = words if isinstance(words, bytes) else " ".join(words).encode()
    data = np.frombuffer(body, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    sums = prefix_sums(data)
    hashed = mixed((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts])
    padded = np.append(data, np.zeros(2, np.uint8)).astype(np.uint64)
    last = np.where(ends > starts, padded[ends - 1], np.uint64(0))
    before = np.where(ends > starts + 1, padded[ends - 2], np.uint64(0))
    shift = np.uint64(64 - CLASSES.bit_length() + 1)
    return hashed, (mixed(last * np.uint64(256) + before + np.uint64(1)) >> shift).astype(np.int64), (mixed(hashed + np.uint64(3)) >> shift).astype(np.int64)


def _learned_from(held: list[bool], lengths: list[int], codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of a slice's training documents."""
    own, lengths = ~np.array(held, bool), np.array(lengths, np.int64)
    return _codes(codes)[np.repeat(own, lengths)], lengths[own]


def _counts(slices: DataFrame) -> DataFrame:
    """token, n: occurrences in training documents, the end among them as the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *of, dictionary in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = np.bincount(_learned_from(*of)[0])
                own = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(_words(dictionary), pa.string()).take(pa.array(own)), pa.array(n[own])], names=["token", "n"])

    return slices.select("held", "lengths", "codes", "dictionary").mapInArrow(tidy(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _cells(vocabulary: DataFrame) -> np.ndarray:
    """Occurrences and words of each class and member: two numbers for each, whatever the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            if b.num_rows:
                _, c, m = named(b.column(0).to_pylist())
                np.add.at(n, c * CLASSES + m, b.column(1).to_numpy())
                words += np.bincount(c * CLASSES + m, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(words)], names=["cell", "n", "words"])

    sums = vocabulary.mapInArrow(tidy(run), "cell long, n long, words long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    out = np.zeros((2, CLASSES * CLASSES), np.int64)
    for cell, n, words in sums.collect():  # CLASSES ** 2 rows
        out[:, cell] = n, words
    return out


def sums_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and for each the sum of its rows; key i is that of row i modulo the number of rows. Keys that come a few times are summed all at once."""
    at = np.argsort(keys, kind="stable")
    keys = keys[at]
    at %= len(rows)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(starts, len(keys)))
    out = np.empty((len(starts), rows.shape[1]), rows.dtype)
    for k in range(1, FEW + 1):
        own = np.flatnonzero(n == k)
        first = starts[own]
        total = rows.take(at[first], axis=0)
        for j in range(1, k):
            total += rows.take(at[first + j], axis=0)
        out[own] = total
    for k in np.flatnonzero(n > FEW).tolist():
        np.add.reduce(rows.take(at[starts[k] : starts[k] + n[k]], axis=0), axis=0, out=out[k])
    return keys[starts], out


class Model:
    """weights: a row for the classes' bias, one for each class's members' bias, then hashed rows. seen: squared gradients so far, by row."""

    def __init__(self, cells: np.ndarray):
        mass = (cells[0] + cells[1] + 1).astype(np.float64)
        self.log_mass = np.log10(mass)  # of what the words of a class and member share
        self.weights = np.zeros((ROWS, CLASSES), np.float32)
        mass = mass.reshape(CLASSES, CLASSES)
        self.weights[0] = np.log(mass.sum(1) / mass.sum())
        self.weights[1 : 1 + CLASSES] = np.log(mass / mass.sum(1, keepdims=True))
        self.seen = np.ones(ROWS, np.float32)

    @staticmethod
    def context(hashed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes of each token's features, of the words before it in its document."""
        n = len(hashed)
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        last, skipped = (np.where(place >= k, np.concatenate([np.full(min(k, n), START), hashed[: max(n - k, 0)]]), START + np.uint64(k)) for k in (1, 2))
        return np.stack([mixed(x ^ s) for x, s in zip([last, skipped, last * np.uint64(3) + skipped], SALTS, strict=True)])

    @staticmethod
    def rows(context: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of weights that each token's class and member are judged by."""
        of_class = (context[:2] % np.uint64(CLASS_ROWS)).astype(np.int64) + (1 + CLASSES)
        of_member = (mixed(context[::2] + c.astype(np.uint64)) % np.uint64(MEMBER_ROWS)).astype(np.int64) + (1 + CLASSES + CLASS_ROWS)
        return of_class, of_member

    def _softmax(self, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the sums of weights of all outcomes, their exponentials and the sums of those."""
        x = self.weights.take(rows[0], axis=0)
        for r in rows[1:]:
            x += self.weights.take(r, axis=0)
        x += bias
        np.clip(x, -MOST, MOST, out=x)
        p = np.exp(x)
        return x, p, p @ ONES

    def score(self, hashed: np.ndarray, c: np.ndarray, m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each token's class's and member's probability."""
        context, out = self.context(hashed, lengths), np.zeros(len(hashed))
        for a in range(0, len(hashed), STEP):
            b = min(a + STEP, len(hashed))
            for rows, bias, of in zip(self.rows(context[:, a:b], c[a:b]), (self.weights[0], self.weights.take(1 + c[a:b], axis=0)), (c[a:b], m[a:b]), strict=True):
                x, _, total = self._softmax(rows, bias)
                out[a:b] += x[np.arange(b - a), of] - np.log(total)
        return out / np.log(10)

    def learn(self, hashed: np.ndarray, c: np.ndarray, m: np.ndarray, lengths: np.ndarray, touched: np.ndarray) -> None:
        """Gradient steps over the tokens, each row's shortened by its gradients so far."""
        context = self.context(hashed, lengths)
        for a in range(0, len(hashed), STEP):
            b = min(a + STEP, len(hashed))
            biases = [(np.zeros(1, np.int64), np.ones((1, b - a), np.float32)), (np.arange(1, 1 + CLASSES), (c[None, a:b] == np.arange(CLASSES)[:, None]).astype(np.float32))]
            for rows, (bias, whose), of in zip(self.rows(context[:, a:b], c[a:b]), biases, (c[a:b], m[a:b]), strict=True):
                _, slope, total = self._softmax(rows, self.weights[0] if len(bias) == 1 else self.weights.take(1 + c[a:b], axis=0))
                slope /= total[:, None]
                slope[np.arange(b - a), of] -= 1
                own, sums = sums_by(rows.ravel().astype(np.uint16), slope)
                own, sums = np.concatenate([own.astype(np.int64), bias]), np.concatenate([sums, whose @ slope])
                seen = self.seen.take(own) + (sums * sums) @ ONES / CLASSES
                self.seen[own] = seen
                sums *= (-RATE / np.sqrt(seen))[:, None]
                sums += self.weights.take(own, axis=0)
                self.weights[own] = sums
                touched[own] = True


def train(slices: DataFrame, cells: np.ndarray) -> Model:
    """Rounds of gradient steps: tasks learn from their slices, and what they changed is averaged over those that changed it."""
    model = Model(cells)
    context = slices.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = context.broadcast((model.weights, model.seen))  # ROWS * (CLASSES + 1) numbers, whatever the input

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, touched = Model(cells), np.zeros(ROWS, bool)
            weights, seen = shared.value
            own.weights, own.seen = weights.copy(), seen.copy()
            for b in batches:
                for *of, dictionary in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    codes, lengths = _learned_from(*of)
                    own.learn(*(x[codes] for x in named(_body(dictionary))), lengths, touched)
            task = TaskContext.get().partitionId()
            for k in range(0, ROWS, BLOCK):
                if (rows := k + np.flatnonzero(touched[k : k + BLOCK])).size:
                    bodies = [rows.astype(np.int32), (own.weights[rows] - weights[rows]).astype(np.float16), own.seen[rows] - seen[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([task]), *(pa.array([x.tobytes()], pa.binary()) for x in bodies)], names=["block", "task", "rows", "change", "seen"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks come one after the other, and tasks in order: sums are the same in every run."""
            block, total, n = None, None, None

            def done() -> pa.RecordBatch:
                own = np.flatnonzero(n)
                return pa.RecordBatch.from_arrays([pa.array([(own + block).astype(np.int32).tobytes()], pa.binary()), pa.array([(total[own] / n[own, None]).astype(np.float32).tobytes()], pa.binary())], names=["rows", "change"])

            for b in batches:
                for k, _, rows, change, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if k != block:
                        if block is not None:
                            yield done()
                        block, total, n = k, np.zeros((BLOCK, CLASSES + 1)), np.zeros(BLOCK)
                    at = np.frombuffer(rows, np.int32) - k
                    total[at, :-1] += np.frombuffer(change, np.float16).reshape(-1, CLASSES)
                    total[at, -1] += np.frombuffer(seen, np.float32)
                    n[at] += 1
            if block is not None:
                yield done()

        learned = slices.filter(F.col("round") == turn).select("held", "lengths", "codes", "dictionary").mapInArrow(tidy(run), "block long, task long, rows binary, change binary, seen binary")
        learned = learned.repartition("block").sortWithinPartitions("block", "task").mapInArrow(tidy(average), "rows binary, change binary")
        for rows, change in learned.collect():  # at most the model's size
            at = np.frombuffer(rows, np.int32)
            change = np.frombuffer(change, np.float32).reshape(-1, CLASSES + 1)
            model.weights[at] += change[:, :-1]
            model.seen[at] += change[:, -1]
        shared.unpersist()
    return model


def _known(slices: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """part, known: of each slice its known codes and their counts, packed. Of a frequent token each slice has one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, dictionary in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = _words(dictionary)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.full(len(words), part)), pa.array(np.arange(len(words), dtype=np.int64))], names=["token", "part", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, code, n = (c.to_numpy() for c in b.columns)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(part))
            bodies = [_packed(np.stack([code[x:y], n[x:y]])) for x, y in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(bodies, pa.binary())], names=["part", "known"])

    entries = slices.select("part", "dictionary").mapInArrow(tidy(run), "token string, part long, code long")
    found = entries.join(vocabulary, "token").select("part", "code", "n").sortWithinPartitions("part", "code")
    return found.mapInArrow(tidy(pack), "part long, known binary").groupBy("part").agg(F.collect_list("known").alias("known"))  # a slice's words at most


def _packed(pairs: np.ndarray) -> bytes:
    """Codes, which rise, and counts: equal high bytes stand together."""
    steps = np.stack([np.diff(pairs[0], prepend=0), pairs[1]]).astype(np.int64)
    return zlib.compress(steps.ravel().view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(8, -1).T).view(np.int64).reshape(2, -1)
    return np.cumsum(steps), n


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are the words of the whole text, A-Z as a-z, and one end. base_score is the log10 probability by counts, one
    added to each; score the model's. Both learn from the rows of ``training`` only. A null text is empty and has the
    end alone; rows with a null id are learned from; repeated rows are rows each; an empty table gives an empty one;
    without training rows every token is unknown and base_score 0; other columns are left out. A row's text is handled
    whole, whatever its length, its tokens in steps.
    """
    spark = docs.sparkSession
    held = ~training(id_col)
    docs = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    with arrow_batches(spark, SLICE):
        slices = materialize(_slices(docs), "lm-slices")
    vocabulary = materialize(_counts(slices), "lm-vocabulary")
    total, words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    cells = _cells(vocabulary)
    model = train(slices, cells)
    shared = spark.sparkContext.broadcast(model)  # bounded as above
    whole = np.log10(total + words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for k in range(b.num_rows):
                ids, held, lengths, body, dictionary, known = (b.column(i)[k] for i in range(6))
                lengths, codes = np.array(lengths.as_py()), _codes(body.as_py())
                hashed, c, m = named(_body(dictionary.as_py()))
                n = np.zeros(len(hashed), np.int64)
                for packed in known.as_py() or []:
                    at, counts = _unpacked(packed)
                    n[at] = counts
                starts = np.cumsum(lengths) - lengths
                counted = np.log10(n + 1.0)
                base = np.add.reduceat(counted[codes], starts) - lengths * whole
                share = counted - model.log_mass[c * CLASSES + m]  # of a word in its class and member
                scored = np.add.reduceat(model.score(hashed[codes], c[codes], m[codes], lengths) + share[codes], starts)
                yield pa.RecordBatch.from_arrays([ids.values, held.values, pa.array(lengths), pa.array(np.add.reduceat((n > 0).astype(np.int64)[codes], starts)), pa.array(base), pa.array(scored)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = slices.select("part", "ids", "held", "lengths", "codes", "dictionary").join(_known(slices, vocabulary), "part", "left").drop("part")
    scored = rows.mapInArrow(tidy(run), f"id {dict(docs.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
