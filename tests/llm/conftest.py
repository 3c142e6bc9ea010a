import random

import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
BASE = " ".join(f"term{k}" for k in range(300))


def odd_texts():
    """Nulls, empty, blank, long, repeated, nearly equal and strange texts."""
    rng = random.Random(3)
    near = BASE.split()
    near[150] = "other"
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "日本語", "🙂", "naïve"]
    return [
        None, "", " \t\n", "one", "one two", "Two words", "two WORDS", "a b c", "a b c d e", LONG, LONG, LONG + " tail", BASE, BASE, " ".join(near), BASE.upper(),
        "x" * 5000, "x" * 5000, "ab" * 900, "\u00a0\u2003 odd\u2028spaces\x00null", "line\r\nline\r\nline", "<|endoftext|> inside <|endoftext|>",
        "mail me: jo.doe+x@mail.example.org, a@b, a@b.c@d.e or 10.0.0.1.5 / 256.1.1.1 / 1.2.3.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and +44 (20) 7946-0958 +1 +123456789012345678",
        "é" * 300 + " 192.168.0.1 🙂 x@y.zz", *(" ".join(rng.choice(words) for _ in range(n)) for n in (3, 40, 400)),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents and the odd texts, ids distinct, over several partitions, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    small = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(100_000 + k, t, "xx", "odd", len(t or "")) for k, t in enumerate(odd_texts())], "doc_id long, text string, lang string, source string, n_chars long")
    both = small.unionByName(odd)
    for name in ("id", "name", "key", "tag", "label", "score", "grams", "spans", "_bad", "_id", "base", "host", "body"):
        both = both.withColumn(name, F.lit("clash"))
    return both.repartition(5).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def twice(spark):
    """Repeated rows, repeated and null ids."""
    return spark.createDataFrame([(1, BASE), (1, BASE), (2, "short text with 10.0.0.1"), (2, "another text of that id"), (None, BASE), (None, None), (3, None)], "doc_id long, text string")
