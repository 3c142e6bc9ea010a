"""Operators that look at the corpus as a whole, against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows):
    """rows: text, lang, source. The audit's rows, by dictionaries."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        own = [t.translate(LOWER) for t in TERMS.findall(text or "")]
        n[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
    out = set()
    for lang in docs:
        kept = [t for t, k in docs[lang].items() if k >= 3]
        groups = {s: c for (x, s), c in n.items() if x == lang}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        for s in groups:
            parts = {
                "pair": [(o, sum((p[s][t] - q[t]) ** 2 // q[t] for t in kept)) for o, q in p.items() if o != s],
                "term": [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if groups[s][t] and p[s][t] > whole[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < 200}
    return out


def divergent(df):
    got = [tuple(r) for r in divergence.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence(docs, monkeypatch):
    """Odd texts, null languages and sources, several shards, clashing names of columns."""
    monkeypatch.setattr(divergence, "SHARD_COUNTS", 3000)
    odd = F.col("doc_id") >= 100_000
    rows = docs.withColumn("lang", F.when(odd & (F.col("doc_id") % 3 == 0), None).otherwise(F.col("lang"))).withColumn("source", F.when(odd, F.when(F.col("doc_id") % 2 == 0, F.lit("Z")).when(F.col("doc_id") % 5 == 0, None).otherwise(F.lit("é"))).otherwise(F.col("source")))
    rows = rows.withColumn("term", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("seat", F.lit(1))
    plain = plain_divergence([(r["text"], r["lang"], r["source"]) for r in rows.select("text", "lang", "source").collect()])
    assert divergent(rows) == plain
    assert {x[0] for x in plain} >= {"", "xx", "en"}


def test_divergence_without_terms(spark, no_docs):
    assert divergent(no_docs) == set()
    few = spark.createDataFrame([("a b", "en", "s"), ("a b", "en", "t"), (None, "en", "u"), ("x", "de", None)], "text string, lang string, source string")
    assert divergent(few) == {("en", a, "pair", b, 0, k + 1) for a, o in {"s": "tu", "t": "su", "u": "st"}.items() for k, b in enumerate(o)}


def test_shares_are_exact():
    for total in (1, 2, 7, 10**15 + 37):
        counts = np.array([0, total // 3, max(total - 2, 0), total - 1], np.int64)
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


@pytest.mark.parametrize("seats", [2, 4, 6, 8])
def test_every_two_seats_meet_once(spark, monkeypatch, seats):
    monkeypatch.setattr(divergence, "SEATS", seats)
    frame = spark.range(seats).select(F.col("id").cast("int").alias("seat"))
    met = [tuple(sorted(r)) for turn in range(seats - 1) for r in frame.select("seat", divergence._opponent(F.col("seat"), turn)).collect()]
    assert Counter(met) == Counter({(a, b): 2 for b in range(seats) for a in range(b)})


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows, rebuild=True):
    """rows: conv_id, turn, role, text. Nodes by tuples of turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    if rebuild:
        heads = {c: crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: heads[c]] + x[heads[c] :] for c, x in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        path = tuple(own[c])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved, out = Counter(), Counter(), set()
    for node in members:
        words = len(WORDS.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members[node]) - 1) * words
    for node, m in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.add((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node], digest))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    got = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def odd_turns():
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of {c % 3}") for c in range(0, 90) if c % 7 for t in range(c % 6)]
    rows += [(200, t, "user", f"long {t} one two") for t in range(700)] + [(2000, t, "user", f"long {t} one two") for t in range(650)]
    rows += [(300, None, "user", "first"), (300, -1, None, None), (300, 5, "b", "tie"), (300, 5, "a", "tie"), (300, 5, "a", "tie"), (300, 5, "a", "")]
    rows += [(None, 1, "user", "of none"), (301, None, None, None), (302, None, None, None), (321, 0, "ab", "c"), (322, 0, "a", "bc")]
    rows += [(c, t, "user", f"copied {t}") for c in range(5000, 5030) for t in range(5)] + [(10**15 + k, 1, "x", "far   apart") for k in (1, 7, 70_000)]
    return rows


def test_trie(spark):
    """Nulls, ties, repeated rows, missing templates, copies, long conversations over several blocks."""
    from eventide.llm import prefix_trie

    rows = odd_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("conv", "pos", "words", "ka", "block", "a")}).repartition(7)
    turns = prefix_trie.sequences(df)
    assert nodes_of(prefix_trie.trie(*prefix_trie.rebuilt(turns))) == plain_trie(rows)
    assert nodes_of(prefix_trie.prefix_trie(df)) == plain_trie(rows, rebuild=False)
    empty = df.limit(0)
    assert nodes_of(prefix_trie.prefix_trie(empty)) == set()
    assert nodes_of(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.sequences(empty)))) == set()


def test_sums_wrap(spark):
    from eventide.llm import prefix_trie

    values = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, -(2**32), 0x123456789ABCDEF]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    for a, b, s in df.select("a", "b", prefix_trie._wrapped(F.col("a"), F.col("b"))).collect():
        assert s == (a + b + 2**63) % 2**64 - 2**63


def plain_tokens(text):
    return [*(w.translate(LOWER) for w in WORDS.findall(text or "")), ""]


def plain_base(rows):
    """rows: doc_id, text. held_out, n_tokens, n_known, train_tokens and base_score of each."""
    held = [d is not None and crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in plain_tokens(text))
    total = sum(c.values())
    out = []
    for (d, text), h in zip(rows, held, strict=True):
        own = plain_tokens(text)
        out.append((d, h, len(own), sum(t in c for t in own), total, sum(log10((c[t] + 1) / (total + len(c) + 1)) for t in own)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_language_model(docs, twice):
    """Counts as a plain version has them, over odd texts, repeated rows and null ids; the model does better on rows it never saw."""
    from eventide.llm import language_model

    for df in (docs, twice):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = [tuple(r) for r in language_model.score(df).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
        for g, w in zip(ordered(got), ordered(plain_base(rows)), strict=True):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] < 0
        if df is docs:
            unseen = [g for g in got if g[1] and g[0] < 100_000]
            assert len(unseen) > 15 and sum(g[6] for g in unseen) > sum(g[5] for g in unseen) + 0.03 * sum(g[2] for g in unseen)


def test_language_model_without_rows(no_docs, spark):
    from eventide.llm import language_model

    assert language_model.score(no_docs).collect() == []
    held = next(k for k in range(100) if crc32(str(k).encode()) % 7 == 2)
    only = language_model.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"]) == (3, 0, 0, 0.0)


def plain_score(model, counts, tokens):
    """log10 of the model's probability of a document's tokens, token by token, from its weights."""
    from eventide.llm import language_model as lm

    hashed, c, m = lm.named(tokens)
    rest, out = Counter(), 0.0
    for w, (k, j) in zip(counts, zip(*lm.named(list(counts))[1:], strict=True), strict=True):
        rest[int(k), int(j)] += counts[w] + 1
    for i in range(len(tokens)):
        context = lm.Model.context(hashed[max(i - 2, 0) : i + 1], np.array([min(i, 2) + 1]))[:, -1:]
        of_class, of_member = lm.Model.rows(context, c[i : i + 1])
        for logits, own in ((model.weights[0] + model.weights[of_class[:, 0]].sum(0), c[i]), (model.weights[1 + c[i]] + model.weights[of_member[:, 0]].sum(0), m[i])):
            p = np.exp(logits.astype(float))
            out += log10(p[own] / p.sum())
        out += log10((counts.get(tokens[i], 0) + 1) / (rest[int(c[i]), int(m[i])] + 1))
    return out


def test_model_is_a_distribution():
    """Scores are those of the softmaxes written out, and the probabilities of all words sum to one, an unknown one for each class and member included."""
    from eventide.llm import language_model as lm

    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(500)]
    texts = [[*rng.choice(words[: 50 * (1 + k % 10)], 60), ""] for k in range(40)]
    counts = Counter(t for x in texts for t in x)
    hashed, c, m = lm.named(list(counts))
    cells = np.zeros((2, lm.CLASSES**2), np.int64)
    np.add.at(cells[0], c * lm.CLASSES + m, list(counts.values()))
    np.add.at(cells[1], c * lm.CLASSES + m, 1)
    model, touched = lm.Model(cells), np.zeros(lm.ROWS, bool)
    flat = [t for x in texts for t in x]
    lengths = np.array([len(x) for x in texts])

    def scored(tokens, lengths):
        h, c, m = lm.named(tokens)
        n = np.array([counts.get(t, 0) for t in tokens])
        return model.score(h, c, m, lengths) + np.log10(n + 1) - model.log_mass[c * lm.CLASSES + m]

    before = scored(flat, lengths).sum()
    for _ in range(3):
        model.learn(*lm.named(flat), lengths, touched)
    assert scored(flat, lengths).sum() > before
    for x in texts[:3]:
        assert scored(x, np.array([len(x)])).sum() == pytest.approx(plain_score(model, counts, x), rel=1e-4)
    known = [10 ** scored(["w1", "w2", t], np.array([3]))[-1] for t in counts]
    context = lm.Model.context(lm.named(["w1", "w2", "x"])[0], np.array([3]))[:, -1:]
    unknown = 0.0
    for k in range(lm.CLASSES):
        of_class, of_member = lm.Model.rows(context, np.array([k]))
        p, q = (np.exp(x) / np.exp(x).sum() for x in (model.weights[0] + model.weights[of_class[:, 0]].sum(0), model.weights[1 + k] + model.weights[of_member[:, 0]].sum(0)))
        unknown += (p[k] * q / 10 ** model.log_mass.reshape(lm.CLASSES, -1)[k]).sum()
    assert sum(known) + unknown == pytest.approx(1, rel=1e-4)
