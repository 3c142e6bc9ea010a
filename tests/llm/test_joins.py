import pytest
from pyspark.sql import functions as F

from eventide.llm import components, decontaminate, ngram_join, suffix_dedup
from tests.llm import brute
from tests.llm.conftest import BASE, LONG, SF


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, texts, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(docs, size, percent).collect()}
    assert got == brute.jaccard_components(texts.items(), size, percent)


def test_jaccard_near_the_limit(spark):
    """Texts that differ from one base in 0 to 60 places, one by one, so that pairs lie close to the limit."""
    words = [f"u{k}" for k in range(400)]
    rows = [(n, " ".join(f"v{n}_{k}" if k % 10 == 3 and k // 10 < n else w for k, w in enumerate(words))) for n in range(0, 40)]
    rows += [(100 + n, " ".join(words[: 400 - n])) for n in range(0, 80, 3)] + [(300 + n, " ".join([f"z{n}"] * n + words[:60])) for n in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for size, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(df, size, percent).collect()}
        assert got == brute.jaccard_components(rows, size, percent)


def test_jaccard_in_chunks(spark, monkeypatch):
    """A large cluster is cut into chunks without losing a link."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 4)
    words = [f"u{k}" for k in range(200)]
    rows = [(n, " ".join(f"v{n}" if k == n else w for k, w in enumerate(words))) for n in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_jaccard_large_clusters(spark, monkeypatch):
    """Clusters of many chunks with links of all kinds: one group of near copies, chains, and sets that nearly link."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 5)
    words = [f"u{k}" for k in range(300)]
    rows = [(n, " ".join(f"v{n}_{k}" if k == 7 * n % 300 else w for k, w in enumerate(words))) for n in range(60)]
    rows += [(100 + n, " ".join(words[n * 3 : 260 + n * 3])) for n in range(14)]
    rows += [(200 + n, " ".join(f"y{n}_{k}" if k % 30 == 11 else w for k, w in enumerate(words))) for n in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 3, 90).collect()}
    assert got == brute.jaccard_components(rows, 3, 90)


def test_jaccard_of_two_thousand_near_copies(spark):
    words = [f"u{k}" for k in range(120)]
    rows = [(n, " ".join([*words[: n % 120], f"v{n}", *words[n % 120 + 1 :]])) for n in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert {r["component_id"] for r in ngram_join.jaccard_join(df, 3, 90).collect()} == {0}
    edges = ngram_join._signatures(df, 3, 90).filter("to is not null").count()
    assert edges < 2000


def test_jaccard_of_lines_that_many_texts_repeat(spark, monkeypatch):
    """Repeated lines do not chain texts that share little else into one cluster; near copies and texts of such lines alone are still linked."""
    import random

    rng = random.Random(6)
    pool = [" ".join(f"l{k}w{j}" for j in range(12)) for k in range(20)]
    texts = []
    for k in range(3000):
        lines = [" ".join(f"r{rng.randrange(10**9)}" for _ in range(rng.choice([9, 14]))) for _ in range(8)] + rng.sample(pool, 4)
        rng.shuffle(lines)
        texts.append(lines)
    texts += [[f"near{k}", *texts[k][:-1], texts[k][-1] + " end"] for k in range(0, 3000, 60)]
    texts += [[*pool[:18], *[f"only{k}"] * k] for k in range(30)]
    rows = list(enumerate("\n".join(t) for t in texts))
    seen, labels = [], ngram_join._labels

    def spy(docs, where, clusters, *how):
        seen.append(clusters.groupBy("label").count().agg(F.max("count")).first()[0])
        return labels(docs, where, clusters, *how)

    monkeypatch.setattr(ngram_join, "_labels", spy)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 5, 80).collect()}
    alone = brute.jaccard_components([(i, t) for i, t in rows if i >= 3000 or i % 60 == 0], 5, 80)
    assert got == {i: alone[i][1] if i in alone else i for i, _ in rows} and len(set(got.values())) == 3001
    assert seen[0] <= 60


def test_jaccard_odd_rows(twice, no_docs):
    rows = ngram_join.jaccard_join(twice).collect()
    assert len(rows) == 7 and {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert [r["component_id"] for r in rows if r["doc_id"] == 3] == [3]
    assert ngram_join.jaccard_join(no_docs).count() == 0


@pytest.mark.parametrize("last", [components.LAST_EDGES, 0])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST_EDGES", last)
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 5), (200, 103), (103, 102)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 200: 102, 103: 102, 102: 102}


def test_containment(spark, docs, texts, twice, no_docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = [(9001, " ".join(LONG.split()[700:720])), (9002, " ".join(BASE.split()[5:290])), (9003, None), (9004, ""), (9005, "one two"), (9006, "a b c d e"), (9001, " ".join(LONG.split()[700:720]))]
    items = items.union(spark.createDataFrame(extra, "item_id long, text string"))
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()}
    assert pairs == brute.contained(texts.items(), known) and len(pairs) > 5
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == texts.keys() - {i for i, _ in pairs}
    assert decontaminate.contained(no_docs, items).count() == decontaminate.contained(docs, items.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.decontaminate(twice, items).collect()} == {2, 3, None}


def test_containment_of_short_and_scattered_items(spark):
    """Short items are all found; of longer ones whose shingles are scattered over long rows at the limit, nearly all."""
    import random

    rng = random.Random(8)
    items, rows = [], []
    for k in range(240):
        n = rng.choice([5, 6, 7, 9, 15, 30, 60])
        words = [f"i{k}_{j}" for j in range(n)]
        items.append((k, " ".join(words)))
        other = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([50, 3000]))]
        place = rng.randrange(len(other))
        rows.append((k, " ".join([*other[:place], *words, *other[place:]])))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k in range(240)}
    odd = decontaminate.contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([((k,), t) for k, t in items[:3]], "item_id struct<n: long>, text string"))
    assert odd.count() == 3


def test_containment_in_portions(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "PORTION", 2000)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()}
    assert pairs == brute.contained(texts.items(), [(r["item_id"], r["text"]) for r in items.collect()])


@pytest.mark.parametrize("pieces", [suffix_dedup.BLOCK_PIECES, 1])
def test_repeats(docs, texts, monkeypatch, pieces):
    """With one piece in a block all is compared window by window, else by the index; both match brute force."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_PIECES", pieces)
    ids = sorted(texts)
    want = dict(zip(ids, brute.without_repeats([texts[i] for i in ids]), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == want


def test_repeats_in_one_text_and_between(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([199, 200, 201, 260])))
    shared = [word() for _ in range(6)]
    rows = [(k, "".join(rng.choice([word(), rng.choice(shared), "z" * rng.choice([150, 210, 400])]) for _ in range(rng.randrange(6)))) for k in range(60)]
    want = dict(zip([k for k, _ in rows], brute.without_repeats([t for _, t in rows]), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, keep=False).collect()}
    assert got == want


def test_repeats_odd_rows(twice, no_docs):
    rows = suffix_dedup.remove_repeats(twice).collect()
    assert len(rows) == 7 and sum(r["n_removed"] == len(BASE) for r in rows) == 3
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_matching_statistics():
    texts = [b"banana bandana", b"a banana", b"", b"bananabanana"]
    index = suffix_dedup.RunLengthIndex(texts)
    whole = b"\0".join(texts) + b"\0"
    got = index.matching_statistics()
    for first, t in zip(index.starts, texts, strict=True):
        for k in range(len(t)):
            want = max((n for n in range(len(t) - k + 1) if any(whole[j : j + n] == t[k : k + n] and b"\0" not in whole[j : j + n] for j in range(len(whole)) if j != first + k)), default=0)
            assert min(got[first + k], len(t) - k) == want


def test_members_hold_the_sets_of_their_names(spark):
    """Of rows that share an id only those with the named set count; other rows and null ids are left out."""
    docs = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "i j k l"), (None, "a b c d"), (3, None)], "id long, text string")
    rows = ngram_join._scan(docs, 3).filter("id = 1 AND n > 0").select("id", "name")
    kept = rows.withColumn("label", F.lit(7).cast("long")).collect()
    for own in kept:
        got = ngram_join._members(docs, spark.createDataFrame([own], "id long, name long, label long"), 3).collect()
        assert [(r["name"], r["label"], len(r["grams"])) for r in got] == [(own["name"], 7, 16)]
    assert len({r["name"] for r in kept}) == 2
