"""Queries over whole tables, against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventide.functions import predicates as P
from eventide.operators import community
from eventide.plans import catalogue
from eventide.sources import adapter as A

SF = "/root/testdata/sf0.001"


def classes(rows, words, links):
    """(id, class_id, component_id, links) of each of rows (id, day), from their words and links (a, b) both ways."""
    least, n = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)
    for a, _ in links:
        n[a] += 1
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if least[a] < least[b]:
                least[b], moved = least[a], True
    copies = {}
    for i, day in sorted(rows):
        copies.setdefault((day, frozenset(words[i])), i)
    return {(i, copies[day, frozenset(words[i])] if n[i] else i, least[i], n[i]) for i, day in rows}


def test_duplicate_candidates_of_every_event(spark):
    rows = A.conferences(spark, SF).filter("NOT archived AND start_date IS NOT NULL AND city IS NOT NULL").selectExpr("id", "start_date", "lower(concat(name, ' ', city)) AS label").collect()
    words = {r["id"]: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in r["label"]).split() if len(w) >= 3 and not w.isdigit() and w not in P.STOP_WORDS} for r in rows}
    want = set()
    for a in rows:
        for b in rows:
            apart = abs((a["start_date"] - b["start_date"]).days)
            if a["id"] != b["id"] and apart <= 30 and len(words[a["id"]] & words[b["id"]]) >= 2:
                want.add((a["id"], b["id"], len(words[a["id"]] & words[b["id"]]), apart))
    whole = A.conferences(spark, SF).filter("NOT archived").withColumn("name", F.concat("name", F.lit(" "), "city"))
    got = [tuple(r) for r in community.duplicate_candidates(whole, whole).collect()]
    assert len(got) == len(want) and set(got) == want
    got = [tuple(r) for r in catalogue.QUERIES["duplicate_candidates_all"](spark, SF).collect()]
    alone = {r["id"] for r in whole.collect()} - {r["id"] for r in rows}
    assert len(got) == whole.count() and set(got) == classes([(r["id"], r["start_date"]) for r in rows], words, [(a, b) for a, b, *_ in want]) | {(i, i, i, 0) for i in alone}
    part = {tuple(r) for r in catalogue.QUERIES["duplicate_candidates"](spark, SF).collect()}
    assert part == {r for r in want if r[0] % 100 == 0} and part


@pytest.mark.parametrize("days, words, span", [(30, 2, 2500), (3, 3, 120), (0, 2, 12)])
def test_classes_of_mixed_names(spark, days, words, span):
    """Names of up to nine words, copies, words in other orders, names of too few words, events without a start or a name."""
    rng, first = random.Random(days), datetime.date(1969, 12, 1)
    names = [" ".join(rng.sample([f"word{i}" for i in range(12 if words > 2 else 40)], rng.randint(0, 9))) for _ in range(120)]
    rows = [(i, rng.choice([*names, None]), None if rng.random() < 0.1 else first + datetime.timedelta(rng.randrange(span))) for i in rng.sample(range(5000), 400)]
    rows += [(9000 + i, " ".join(rng.sample(["hot", "copies", "everywhere"], 3)), first) for i in range(50)]
    said = {i: set((name or "").split()) for i, name, _ in rows}
    links = [(a, b) for a, _, x in rows for b, _, y in rows if a != b and x and y and abs((x - y).days) <= days and len(said[a] & said[b]) >= words]
    want = classes([(i, day) for i, _, day in rows], said, links)
    got = [tuple(r) for r in community.duplicate_classes(spark.createDataFrame(rows, "id long, name string, start_date date"), days, words).collect()]
    assert len(got) == len(rows) and set(got) == want and 1 < len({c for _, _, c, n in want if n})


def test_copies_are_not_expanded(spark):
    """5,000 events of one text are one row of links, not 25 million pairs."""
    rows = spark.range(5000).select("id", F.lit("Cardiac Imaging Leeds").alias("name"), F.lit("1998-06-01").cast("date").alias("start_date"))
    found = community.duplicate_classes(rows)
    assert {tuple(r) for r in found.select("class_id", "component_id", "links").collect()} == {(0, 0, 4999)} and found.count() == 5000


def test_alerts_of_every_user(spark):
    events = [(r["specialty"].lower(), r["created_on"]) for r in A.conferences(spark, SF).filter("NOT archived").select("specialty", "created_on").collect()]
    last, want = datetime.date.fromisoformat(A.AS_OF), set()
    for u in A.raw(spark, SF, "customer").collect():
        c = u["c_custkey"]
        mark = datetime.date(1998, 1, 1) + datetime.timedelta(c % 150) if c % 3 else datetime.date.min
        days = [d for s, d in events if c % 7 and s == u["c_mktsegment"].lower() and mark < d <= last]
        if days:
            want.add((c, len(days), max(days), min(len(days), 50)))
    got = [tuple(r) for r in catalogue.QUERIES["specialty_alerts_all"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in catalogue.QUERIES["specialty_alerts"](spark, SF).collect()} == want


def test_pairs_of_duplicates_are_not_shuffled(spark):
    for name in ("duplicate_candidates", "duplicate_candidates_all"):
        pairs = catalogue.QUERIES[name](spark, SF)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Aggregate" in line and "event_id" in line]
