"""N-gram Jaccard join by vertical partitioning of a global n-gram order.

The order is that of the n-grams' hashes, and it is cut into fragments. Two sets that link differ in so few n-grams that
they agree on a whole fragment, if there are more fragments than differences; so equal fragments name the clusters of
sets that may link. Fragments of common n-grams alone, as repeated lines have them, would chain sets that share little
else into ever larger clusters; they are used only where a set has too few others. In a cluster the partial overlaps of
its pairs are counted in fragments of the order, one after the other, and summed for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import materialize, mixed, shingles, slices, tidy, utf8, word_hashes
from eventide.llm.components import components, roots

AT_ONCE = 1_000_000
#: The numbers of fragments in use grow by this ratio.
LADDER = sorted({int(np.ceil(1.5**k)) for k in range(1, 60)})
#: A fragment with fewer uncommon n-grams says little and names no cluster, unless a set has too few others.
THICK = 2
#: Which fragments name clusters, as far as a set needs them: of which order, how many levels finer, and up to which rank.
STEPS = [(0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 1, 1), (0, 2, 1), *((order, 0, 2) for order in range(4))]
#: An n-gram is common if OFTEN or more sets of a SHARE-th part of all have it; so many are told to each task at most, the most frequent.
SHARE, OFTEN, MOST_COMMON = 16, 4, 1 << 19
NONE = np.zeros(0, np.uint64)
#: Sets of a cluster that are compared in one task, and their n-grams together.
CHUNK_SETS, CHUNK_GRAMS = 1024, 1_000_000
#: Sets of each component of a large cluster's chunk that are compared with those of the other chunks first.
HEADS = 8
#: N-grams of a chunk whose overlaps are counted at a time.
COLUMNS = 4096


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each text."""
    data, offsets = utf8(column)
    for a, b in slices(offsets, AT_ONCE):
        own = offsets[a : b + 1]
        words, _, _, first = word_hashes(data[own[0] : own[-1]], own - own[0], True)
        grams, at = shingles(words, first, size)
        for k in range(b - a):
            yield a + k, np.unique(grams[at[k] : at[k + 1]])


def _name(grams: np.ndarray) -> int:
    """A 64-bit name of a set, whatever its order; equal sets have equal names."""
    return int(mixed(mixed(grams).sum(keepdims=True) + np.uint64(len(grams))).view(np.int64)[0]) if len(grams) else 0


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """id, n, name of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, name = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for k, grams in _sets(b.column(1), size):
                n[k], name[k] = len(grams), _name(grams)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(name)], names=["id", "n", "name"])

    return docs.select("id", "text").mapInArrow(tidy(run), f"id {dict(docs.dtypes)['id']}, n long, name long")


def _differences(n: int, percent: int) -> int:
    """N-grams that a set of n and one that it links with can have in one of them only, at most."""
    return (100 - percent) * (n + n * 100 // percent) // (100 + percent)


def _level(n: int, percent: int) -> int:
    need = 11 * (_differences(n, percent) + 1) // 10 + 1
    return int(np.searchsorted(LADDER, need))


def _common(docs: DataFrame, where: DataFrame, size: int) -> np.ndarray:
    """Common n-grams in ascending order: those of lines that many texts repeat, or of large groups of copies.

    They are counted on a part of the sets (where: id, name), each of them once. They only say which fragments name
    clusters first: whichever they are, sets that link come into one cluster.
    """
    part = lambda df: df.filter(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grams in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(grams, np.int64))], names=["gram"])

    members = _members(part(docs), part(where).select("id", "name"), size)
    times = members.select("grams").mapInArrow(tidy(run), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    most = times.filter(F.col("times") >= OFTEN).orderBy(F.desc("times"), "gram").limit(MOST_COMMON).select("gram").toArrow()
    return np.sort(most.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def _cut(own: np.ndarray, usual: np.ndarray, level: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, rank and place of each fragment that is not empty. Rank 0: it has THICK uncommon n-grams; 1: one at least; 2: THICK of any sort; 3: fewer."""
    part = ((own >> np.uint64(32)) * np.uint64(LADDER[level]) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    size = np.diff(np.append(starts, len(own)))
    rare = size - np.add.reduceat(usual, starts)
    rank = np.where(rare >= THICK, 0, np.where(rare > 0, 1, np.where(size >= THICK, 2, 3)))
    body = np.add.reduceat(mixed(own + np.uint64(level)), starts)
    place = (part[starts] + (level << 40) + (order << 36)).astype(np.uint64)
    return mixed(mixed(place) ^ body), rank, part[starts]


def fragments(grams: np.ndarray, percent: int, common: np.ndarray = NONE) -> np.ndarray:
    """Signatures of a set's fragments. Two sets that link have one in common, or are equal, whatever n-grams are common (sorted)."""
    n = len(grams)
    off = _differences(n, percent)
    if not off:
        return np.zeros(0, np.uint64)  # it links with equal sets only
    at = np.searchsorted(common, grams)
    usual = (common[np.minimum(at, len(common) - 1)] == grams).astype(np.int64) if len(common) else np.zeros(n, np.int64)
    orders, out = {0: (grams, usual)}, []
    for level in range(_level(n, percent), _level(n * 100 // percent, percent) + 1):  # also what a larger partner uses
        cuts, said = {}, {}
        for order, finer, most in STEPS:
            if order not in orders:
                own = mixed(grams ^ np.uint64(order * 0x9E3779B9))
                by = np.argsort(own)
                orders[order] = own[by], usual[by]
            if (order, finer) not in cuts:
                cuts[order, finer] = _cut(*orders[order], level + finer, order)
            sig, rank, part = cuts[order, finer]
            out.append(sig[(rank > said.get((order, finer), -1)) & (rank <= most)])
            said[order, finer] = most
            # a difference is in one fragment only, so of more fragments than differences one agrees; and a partner that
            # had enough after an earlier step agrees with this set there
            if np.count_nonzero(rank <= most) > off:
                break
        else:  # the thin and empty fragments of the last order too, so that nothing is lost
            out.append(sig[rank > most])
            if len(part) <= off:
                empty = np.setdiff1d(np.arange(LADDER[level]), part)
                out.append(mixed(mixed((empty + (level << 40) + (15 << 36)).astype(np.uint64))))
    return np.concatenate(out)


def _signatures(docs: DataFrame, size: int, percent: int, common: np.ndarray = NONE) -> DataFrame:
    """sig, name: each signature of a batch's sets, with the smallest set that a set with it reaches within the batch;
    and, without a signature, every other set with that one (to). So a batch sends one edge for each of its sets at most."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # MOST_COMMON numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, names, had = [], [], set()
            for _, grams in _sets(b.column(0), size):
                name = _name(grams)
                if not len(grams) or name in had:
                    continue
                had.add(name)
                s = fragments(grams, percent, shared.value)
                sigs.append(s.view(np.int64)), names.append(np.full(len(s), name))
            if not any(map(len, sigs)):
                continue  # small sets link with equal ones only
            sig, (known, at) = np.concatenate(sigs), np.unique(np.concatenate(names), return_inverse=True)
            by = np.argsort(sig, kind="stable")
            sig, at = sig[by], at[by]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            root = roots(len(known), at, np.repeat(at[first], np.diff(np.append(first, len(sig)))))
            yield pa.RecordBatch.from_arrays([pa.array(sig[first]), pa.array(known[root[at[first]]]), pa.nulls(len(first), pa.int64())], names=["sig", "name", "to"])
            rest = np.flatnonzero(root != np.arange(len(known)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.array(known[rest]), pa.array(known[root[rest]])], names=["sig", "name", "to"])

    return docs.select("text").mapInArrow(tidy(run), "sig long, name long, to long")


def _clusters(docs: DataFrame, size: int, percent: int, common: np.ndarray = NONE) -> DataFrame:
    """node, label: sets that may link have one label. A batch sends one row for each signature; those of a signature come one after the other and are linked with the first, none of them held."""
    rows = _signatures(docs, size, percent, common)
    # rows that already are edges are dealt apart from each other
    dealt = rows.repartition(F.coalesce("sig", F.xxhash64("name", "to"))).sortWithinPartitions("sig")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0  # the signature before, and the first set that has it
        for b in batches:
            edge = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            name = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(name[edge]), b.column(2).drop_null()], names=["a", "b"])
            sig, name = b.column(0).drop_null().to_numpy(), name[~edge]
            if len(sig):
                starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                heads = name[starts].copy()
                if last is not None and sig[0] == last:
                    heads[0] = first
                to = np.repeat(heads, np.diff(np.append(starts, len(sig))))
                last, first = int(sig[-1]), int(heads[-1])
                apart = name != to
                yield pa.RecordBatch.from_arrays([pa.array(name[apart]), pa.array(to[apart])], names=["a", "b"])

    return components(dealt.mapInArrow(tidy(link), "a long, b long").distinct())


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the overlaps of all pairs of a chunk: counted in one fragment of the order after the other, and summed."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams = np.concatenate(sets)
    by = np.argsort(grams, kind="stable")
    grams, owner = grams[by], owner[by]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # what one set alone has is in no overlap
    owner, column = owner[shared], np.cumsum(new & shared)[shared] - 1
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        total += has @ has.T
    return total


def _linked(names: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold a unit's sets together: each set with the first of its component, over the links between sides 1 and 2 (3: both)."""
    n = np.array([len(s) for s in sets], np.float32)
    both = _overlaps(sets)
    a, b = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
    apart = (side[a] & 1) & (side[b] >> 1) | (side[b] & 1) & (side[a] >> 1)
    a, b = a[apart == 1], b[apart == 1]
    label = roots(len(sets), a, b)
    own = np.flatnonzero(label != np.arange(len(sets)))
    return names[own], names[label[own]]


UNIT = ["label", "lo", "hi"]


def _chunks(own: DataFrame) -> DataFrame:
    """label, chunks: into how many chunks of bounded size each label's sets go."""
    return own.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_GRAMS)).cast("int").alias("chunks"))


def _members(docs: DataFrame, own: DataFrame, size: int) -> DataFrame:
    """own's columns and grams of the sets of own (id, name, ...), from one row's text each. The only step in which texts are shuffled, once, however many ids there are."""
    kept = [c for c in own.columns if c != "id"]
    texts = docs.select("id", "text").join(own.hint("merge"), "id").select("text", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, rows, held = b.column(1 + kept.index("name")).to_pylist(), {}, 0
            for k, grams in _sets(b.column(0), size):
                if _name(grams) == name[k]:  # else another row that has the same id
                    rows[k] = grams.tobytes()
                    held += grams.nbytes
                if rows and (held > AT_ONCE or k + 1 == b.num_rows):
                    own = pa.array(list(rows))
                    yield pa.RecordBatch.from_arrays([*(b.column(1 + i).take(own) for i in range(len(kept))), pa.array(list(rows.values()), pa.binary())], names=[*kept, "grams"])
                    rows, held = {}, 0

    return texts.mapInArrow(tidy(run), ", ".join([*(f"{c} {dict(own.dtypes)[c]}" for c in kept), "grams binary"]))


def _units(members: DataFrame, own: DataFrame) -> DataFrame:
    """label, lo, hi, side, name, grams: the sets of own (name, label, lo, hi, los, his) in their units.

    A set is in the unit (label, lo); or, with his, on side 1 of the units (label, lo, 0 to his) and, with its own hi,
    on side 2 of the units (label, 0 to los, hi).
    """
    ways = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    unit = lambda lo, hi, side: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(side).alias("side"))
    alone = F.array(unit(F.col("lo"), F.lit(-1), 3))
    first = F.when(F.col("his") > 0, ways("his", lambda x: unit(F.col("lo"), x, 1))).otherwise(alone)
    second = F.when((F.col("hi") >= 0) & (F.col("los") > 0), ways("los", lambda x: unit(x, F.col("hi"), 2))).otherwise(F.slice(alone, 1, 0))
    return members.select("name", "grams").join(own.select("name", "label", F.inline(F.concat(first, second))), "name").select("label", "lo", "hi", "side", "name", "grams")


def _compared(parts: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that hold together what links within units, side 1 with side 2 (3: both). Units are compared each by itself."""
    parts = parts.repartition(*UNIT).sortWithinPartitions(*UNIT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units come sorted, one after the other; two chunks at most are held."""
        unit, held = None, {}

        def done() -> pa.RecordBatch:
            a, b = (), ()
            if len(held) > 1:
                names = np.array(sorted(held))
                a, b = _linked(names, [np.frombuffer(held[x][0], np.uint64) for x in names.tolist()], np.array([held[x][1] for x in names.tolist()]), percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            for label, lo, hi, side, name, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (label, lo, hi) != unit:
                    if held:
                        yield done()
                    unit, held = (label, lo, hi), {}
                held[name] = grams, side | held.get(name, (b"", 0))[1]  # on both sides where its chunk meets itself
        if held:
            yield done()

    return parts.mapInArrow(tidy(compare), "a long, b long")


def _labels(docs: DataFrame, where: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """name, group: of each set in a cluster the name of its component of links.

    A cluster is cut into chunks, of which each is compared within. Where a cluster has several, some sets of each
    component found so far are compared next, which joins the components of copies. Last, what is not in a cluster's
    largest component meets the cluster's sets of all other chunks: so every pair that no chain of links joins already
    has been counted, and a group of copies costs in proportion to its size.
    """
    own = materialize(clusters.withColumnRenamed("node", "name").join(where, "name").select("id", "name", "label", "n"), "ngram-clusters")
    spread = lambda n, salt=0: F.pmod(F.xxhash64("name", F.lit(salt)), F.col(n)).cast("int")
    own = own.join(_chunks(own), "label").withColumn("lo", spread("chunks"))
    members = materialize(_members(docs, own.drop("n"), size), "ngram-members")
    alone = [F.lit(-1).alias("hi"), F.lit(0).alias("los"), F.lit(0).alias("his")]
    # a set is in one unit only, so its link to the first of its component there is its group so far
    found = _compared(members.select("label", "lo", F.lit(-1).alias("hi"), F.lit(3).alias("side"), "name", "grams"), percent)
    own = own.drop("lo")
    groups = materialize(own.join(found.select(F.col("a").alias("name"), F.col("b").alias("group")), "name", "left").withColumn("group", F.coalesce("group", "name")), "ngram-groups")
    done = groups.filter("chunks = 1").select("name", "group")
    groups = groups.filter("chunks > 1").withColumnRenamed("chunks", "los")
    if groups.isEmpty():
        return done
    members = members.filter("chunks > 1")

    def merged(links: DataFrame) -> DataFrame:
        """The groups, those that links (a, b) join under one name."""
        of = lambda c: groups.select(F.col("name").alias(c), F.col("group").alias(f"of_{c}"))
        pairs = links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        named = components(pairs).select(F.col("node").alias("group"), F.col("label").alias("further"))
        return materialize(groups.join(named, "group", "left").withColumn("group", F.coalesce("further", "group")).drop("further"), "ngram-groups")

    place = F.row_number().over(Window.partitionBy("label", "group").orderBy(F.xxhash64("name"), "name"))
    some = materialize(groups.withColumn("place", place).filter(F.col("place") <= HEADS), "ngram-heads")
    groups = merged(_compared(_units(members, some.join(_chunks(some), "label").select("name", "label", spread("chunks", 1).alias("lo"), *alone)), percent))
    largest = groups.groupBy("label", "group").agg(F.count(F.lit(1)).alias("sets")).groupBy("label").agg(F.max_by("group", F.struct("sets", "group")).alias("largest"))
    judged = groups.join(largest, "label").withColumn("rest", F.col("group") != F.col("largest"))
    rest = _chunks(judged.filter("rest")).withColumnRenamed("chunks", "his")
    last = materialize(judged.join(rest, "label").select("name", "label", spread("los").alias("lo"), F.when(F.col("rest"), spread("his")).otherwise(-1).alias("hi"), "los", "his"), "ngram-rest")
    if not last.isEmpty():
        groups = merged(_compared(_units(members, last), percent))
    return done.union(groups.select("name", "group"))


def jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id of every row: the smallest id that it reaches by links, itself included.

    A row's set are its distinct runs of `size` words, of the whole text, A-Z as a-z; with fewer words, the whole
    sequence; without words or text, nothing, and no link. Rows link when their sets' overlap is `percent` hundredths
    of their union at least. Rows with equal sets are one class from the start. Classes that agree on a fragment of
    the order form clusters; in a cluster every pair is counted, in chunks of bounded size, so no link is lost.
    A row with a null id has no component and links nothing; ids that repeat stand for all their rows' texts; other
    columns are left out; an empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(_scan(docs, size), "ngram-sets")
    known = docs.filter("id is not null")
    where = rows.filter("id is not null AND n > 0").groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    clusters = _clusters(known, size, percent, _common(known, where, size))
    labels = _labels(known, where, clusters, size, percent)
    # a component's name becomes its smallest id; rows of one id are one document
    best = where.join(labels, "name", "left").select("name", "id", F.coalesce("group", "name").alias("label"))
    lowest = best.groupBy("label").agg(F.min("id").alias("component_id"))
    best = best.join(lowest, "label").select("name", "component_id")
    done = rows.join(best, "name", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
