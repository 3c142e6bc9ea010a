"""Source divergence audit by systolic rotation.

Each language's kept terms are cut into shards of bounded size. In a shard every source has one compressed vector of
counts and a seat. Vectors at their seats stay resident in their partitions; in the rounds of a round-robin tournament
the vectors of one seat visit another's, each two seats meet once, and both directions are evaluated there. Terms that
a source has more often than its language are ranked by heaps within each shard, whose best are ranked together.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import arrow_batches, clean_text, materialize, tidy
from eventide.llm.words import TERM, byte_slices, runs

AT_ONCE = 8_000_000
#: Documents of a language that a kept term has at least, and ranks of terms that are reported.
LEAST_DOCUMENTS, RANKS = 3, 200
#: Counts in a shard of the terms, about, and seats in it (an even number).
SHARD_COUNTS, SEATS = 300_000, 6
SCALE = 1_000_000_000
CELL = ["lang", "shard", "seat"]


def _counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and rows that have it, summed within slices of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in byte_slices(whole.column(2), AT_ONCE):
                b = whole.slice(first, last - first)
                found, at = runs(b.column(2), TERM)
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                terms = len(coded.dictionary)
                lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                own = np.repeat(np.arange(b.num_rows, dtype=np.int64), np.diff(at)) * terms + coded.indices.to_numpy()
                own, n = np.unique(own, return_counts=True)
                key = group[own // terms] * terms + own % terms
                by = np.argsort(key, kind="stable")
                key, n = key[by], n[by]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                group, term = np.divmod(key[starts], terms)
                of_lang, of_source = np.divmod(group, len(source.dictionary))
                rows = np.diff(np.append(starts, len(key)))
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(of_lang)), source.dictionary.take(pa.array(of_source)), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(np.add.reduceat(n, starts)), pa.array(rows)],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return docs.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # equal high bytes stand together


def _unpacked(body: bytes | None) -> np.ndarray:
    if body is None:
        return np.zeros(0, np.int64)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _vectors(kept: DataFrame) -> DataFrame:
    """lang, shard, source, terms, ids, counts, dictionary: a row for each source that has terms there, and one, without source, for the language."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("term", "ascending"), ("source", "ascending")]).combine_chunks()
        term = rows["term"].combine_chunks().dictionary_encode()  # in order, so ids rise
        source = rows["source"].combine_chunks().dictionary_encode()
        ids, n, of = term.indices.to_numpy().astype(np.int64), rows["n"].to_numpy(), source.indices.to_numpy()
        size = len(term.dictionary)
        total = np.zeros(size, np.int64)
        np.add.at(total, ids, n)
        named = zlib.compress("\n".join(term.dictionary.to_pylist()).encode(), 1)
        out = [(None, _packed(np.ones(size)), _packed(total), named, int(total.sum()))]
        by = np.argsort(of, kind="stable")
        at = np.searchsorted(of[by], np.arange(len(source.dictionary) + 1))
        for k, name in enumerate(source.dictionary.to_pylist()):
            own = by[at[k] : at[k + 1]]
            out.append((name, _packed(np.diff(ids[own], prepend=-1)), _packed(n[own]), None, int(n[own].sum())))
        names, steps, counts, dictionary, sums = zip(*out, strict=True)
        same = [pa.array([v.as_py()] * len(out), t) for v, t in zip(key, (pa.string(), pa.int64()), strict=True)]
        return pa.Table.from_arrays([*same, pa.array(names, pa.string()), pa.array([size] * len(out), pa.int64()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary()), pa.array(dictionary, pa.binary()), pa.array(sums, pa.int64())], names=["lang", "shard", "source", "terms", "steps", "counts", "dictionary", "occurrences"])

    return kept.groupBy("lang", "shard").applyInArrow(run, "lang string, shard long, source string, terms long, steps binary, counts binary, dictionary binary, occurrences long")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly: long division in steps that stay within 64 bits."""
    out, left = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, total)
        out = out * 1000 + digit
    return out + 1


class _Seat:
    """The vectors of a cell's sources, as shares of all terms of the shard."""

    def __init__(self, rows: pa.Table):
        self.sources = rows["source"].to_pylist()
        self.totals = rows["total"].to_pylist()
        self.size = rows["terms"][0].as_py()
        self.ids = [np.cumsum(_unpacked(x)) - 1 for x in rows["steps"].to_pylist()]
        self.counts = [_unpacked(x) for x in rows["counts"].to_pylist()]

    def shares(self, k: int) -> np.ndarray:
        out = np.full(self.size, shares(np.zeros(1, np.int64), self.totals[k])[0])
        out[self.ids[k]] = shares(self.counts[k], self.totals[k])
        return out


def _meet(a: _Seat, i: int, p: np.ndarray, b: _Seat, j: int, q: np.ndarray) -> tuple[int, int]:
    """Both directions' sums over the shard's terms; what neither source has is one value, times its terms."""
    if len(a.ids[i]) + len(b.ids[j]) < a.size // 2:
        at = np.union1d(a.ids[i], b.ids[j])
        p0, q0 = (int(shares(np.zeros(1, np.int64), t)[0]) for t in (a.totals[i], b.totals[j]))
        rest, square = a.size - len(at), (p0 - q0) ** 2
        p, q = p[at], q[at]
    else:
        rest, square, p0, q0 = 0, 0, 1, 1
    squares = (p - q) ** 2
    return int((squares // q).sum()) + rest * (square // q0), int((squares // p).sum()) + rest * (square // p0)


SUMS = "lang string, source string, item string, part string, value long"


def _sums(lang: str, rows: list[tuple]) -> pa.Table:
    cells = list(zip(*rows, strict=True)) or [[]] * 4
    source, item, part, value = (pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))
    return pa.Table.from_arrays([pa.array([lang] * len(rows), pa.string()), source, item, part, value], names=["lang", "source", "item", "part", "value"])


def _visit(key: tuple, resident: pa.Table, visiting: pa.Table) -> pa.Table:
    """A meeting of two seats of a shard: every source of one with every source of the other, both ways."""
    if not (resident.num_rows and visiting.num_rows):
        return _sums("", [])
    here, there = _Seat(resident), _Seat(visiting)
    own, rows = [here.shares(i) for i in range(len(here.sources))], []
    for j, visitor in enumerate(there.sources):
        q = there.shares(j)
        for i, host in enumerate(here.sources):
            f, g = _meet(here, i, own[i], there, j, q)
            rows += [(host, visitor, "pair", f), (visitor, host, "pair", g)]
    return _sums(key[0].as_py(), rows)


def _home(key: tuple, resident: pa.Table, language: pa.Table) -> pa.Table:
    """A seat's sources with each other, and each with its language, for the terms that it has more often."""
    if not resident.num_rows:
        return _sums("", [])
    here, whole = _Seat(resident), _Seat(language)
    own, q, rows = [here.shares(i) for i in range(len(here.sources))], whole.shares(0), []
    terms = zlib.decompress(language["dictionary"][0].as_py()).decode().split("\n")
    for i, host in enumerate(here.sources):
        for j in range(i):
            f, g = _meet(here, i, own[i], here, j, own[j])
            rows += [(host, here.sources[j], "pair", f), (here.sources[j], host, "pair", g)]
        ids = here.ids[i][own[i][here.ids[i]] > q[here.ids[i]]]
        f = (own[i][ids] - q[ids]) ** 2 // q[ids]
        if len(f) > RANKS:
            best = f >= np.partition(f, -RANKS)[-RANKS]
            ids, f = ids[best], f[best]
        rows += [(host, terms[k], "term", -v) for v, k in heapq.nsmallest(RANKS, zip((-f).tolist(), ids.tolist(), strict=True))]
    return _sums(key[0].as_py(), rows)


def _opponent(seat: Column, turn: int) -> Column:
    """Whom a seat meets in a round: the circle method, the last seat fixed."""
    others = SEATS - 1
    half = turn * (others + 1) // 2 % others
    return F.when(seat == others, F.lit(half)).when(seat == half, F.lit(others)).otherwise(F.pmod(F.lit(turn) - seat, F.lit(others))).cast("int")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms are from those of its language's other sources.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z as a-z. A language keeps the terms that 3 of its
    rows have at least. Shares are exact whole numbers, 1 + floor(10**9 * (count + 1) / (occurrences + terms)), over kept
    terms. Part pair: for each other source of the language the sum over all kept terms of (p - q)**2 / q, rounded down
    term by term, all ranks. Part term: the kept terms that the source has and whose share exceeds the language's,
    valued likewise, 200 ranks. Ranks go by value, the largest first, then by the item's bytes.

    Null texts, languages and sources are empty ones; empty texts have no terms, but their source is there; repeated
    rows count as rows each; a language without kept terms has pairs of value 0; a source alone in its language has no
    pairs; an empty table gives an empty one; other columns are left out.
    """
    docs = docs.select(clean_text(lang_col).alias("lang"), clean_text(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    groups = materialize(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), "divergence-groups")
    counts = _counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter(F.col("docs") >= LEAST_DOCUMENTS)
    with arrow_batches(docs.sparkSession, AT_ONCE):
        kept = materialize(kept.select("lang", "term", "source", "n"), "divergence-counts")
    shards = kept.count() // SHARD_COUNTS + 1
    vectors = materialize(_vectors(kept.withColumn("shard", F.pmod(F.xxhash64("term", "lang"), F.lit(shards)))), "divergence-vectors")

    whole = vectors.filter("source IS NULL")
    v = whole.groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("occurrences").alias("of_lang"))
    own = vectors.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("occurrences").alias("of_source"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    seated = groups.join(v, "lang").join(own, ["lang", "source"], "left").select("lang", "source", (F.coalesce("of_source", F.lit(0)) + F.col("v")).alias("total"), (place % SEATS).alias("seat"))
    cells = whole.select("lang", "shard", "terms").join(seated, "lang").join(vectors.select("lang", "shard", "source", "steps", "counts"), ["lang", "shard", "source"], "left")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # dealt once: every round brings visitors to where the residents are; lost blocks are dealt again from the files
    residents = materialize(cells, "divergence-cells").repartition(partitions, *CELL).persist(StorageLevel.DISK_ONLY)
    languages = whole.join(v, "lang").select("lang", "shard", "terms", "steps", "counts", "dictionary", F.lit(None).cast("string").alias("source"), (F.col("of_lang") + F.col("v")).alias("total"))
    languages = languages.withColumn("seat", F.explode(F.array(*map(F.lit, range(SEATS)))))
    found = [materialize(_summed(residents.groupBy(*CELL).cogroup(languages.groupBy(*CELL)).applyInArrow(_home, SUMS)), "divergence-round")]
    for turn in range(SEATS - 1):
        host = _opponent(F.col("seat"), turn)
        visiting = residents.withColumn("host", host).filter("host < seat").drop("seat").withColumnRenamed("host", "seat")
        met = residents.groupBy(*CELL).cogroup(visiting.groupBy(*CELL)).applyInArrow(_visit, SUMS)
        found.append(materialize(_summed(met), "divergence-round"))
    residents.unpersist()

    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    values = _summed(values)
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = others.withColumn("part", F.lit("pair")).join(values.filter("part = 'pair'"), ["lang", "source", "part", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    # each task's best are found before the shuffle
    terms = values.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= RANKS)
    return pairs.withColumn("rank", rank).select(*out).union(terms.select(*out))


def _summed(met: DataFrame) -> DataFrame:
    """Sums of what the shards found; a term is in one shard only."""
    return met.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
