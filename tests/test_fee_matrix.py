"""Fee grids in text on written cases: by rows, by columns, by tabs."""

from pyspark.sql import functions as F

from eventide.operators import fee_matrix
from tests.test_texts import results


def read(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, text string").repartition(2)
    found = fee_matrix.tiers(df).orderBy("page_id", "place").collect()
    return [[(r.label, r.price, r.currency, r.early, r.deadline and str(r.deadline)) for r in found if r.page_id == k] for k in range(len(pages))]


def short(rows):
    return [r[:3] for r in rows]


def test_cells(spark):
    cases = [("EUR300,00  EUR170,00", [300.0, 170.0]), ("300 € 170 € 90 €", [300.0, 170.0, 90.0]), ("300 EUR 170 EUR", [300.0, 170.0]), ("£1 | - | n/a", [1.0, None, None]), ("$ 399 $ 499 $ 599", [399.0, 499.0, 599.0]), ("CHF 1'200", [1200.0]), ("free", [None]), ("300 400", None), ("Member £5", None), ("£350–£400", None), ("By July 15th", None), ("", None), (None, None)]
    got, want = results(spark, cases, lambda c: F.transform(fee_matrix.cells(c), lambda x: x["amount"]), "array")
    assert got == want


def test_times(spark):
    cases = [("By July 15th", True), ("Early bird", True), ("Late:", True), ("Onsite", True), ("On site", False), ("After the congress", True), ("On behalf of us", False), ("Members", False), ("Regular fee", True), ("", False)]
    got, want = results(spark, cases, fee_matrix.is_time, "boolean")
    assert got == want


def test_grids(spark):
    pages = [
        "Registration fees\nMD, PhD\nResidents\nStudents\nESSIC MEMBERS\nBy July 15th\nEUR300,00\nEUR170,00\nEUR90,00\nAfter July 15th: EUR350,00 EUR200,00 EUR100,00\nNON MEMBERS\nBy July 15th EUR400 EUR250 EUR1.200,00\n",
        "Fees\nEarly bird\nStandard\nLate\nMEMBERS\nDoctor\n£300\n£350\n£400\nNurse  £100 £150 n/a\nEnd\nOther £1 £2 £3",
        "Dear all\nRegistration Type\tEarly Bird\n2026-05-31\tMid Term\n2026-09-15\tFinal Call\n2026-11-21\tQty\nSpeaker Registration\t$ 399\t$ 499\t$ 599\t\nStudent\t$ 199\t$ 299\t$ 399\t1",
        "Registration Type\tEarly Bird\n2026-05-31\tFinal Call\nSpeaker\t$ 399\t$ 499\nStudent\t$ 199\t$ 299",
        "Early bird\nLate\nOne £1 £2", "nothing here\nat all", "", None,
    ]
    got = read(spark, pages)
    assert short(got[0]) == [
        *((f"ESSIC Members · {c} · By July 15th", p, "EUR") for c, p in (("MD, PhD", 300.0), ("Residents", 170.0), ("Students", 90.0))), *((f"ESSIC Members · {c} · After July 15th", p, "EUR") for c, p in (("MD, PhD", 350.0), ("Residents", 200.0), ("Students", 100.0))),
        *((f"Non Members · {c} · By July 15th", p, "EUR") for c, p in (("MD, PhD", 400.0), ("Residents", 250.0), ("Students", 1200.0))),
    ]
    assert [r[3] for r in got[0]] == [True] * 3 + [False] * 3 + [True] * 3
    assert short(got[1]) == [("Members · Doctor · Early bird", 300.0, "GBP"), ("Members · Doctor · Standard", 350.0, "GBP"), ("Members · Doctor · Late", 400.0, "GBP"), ("Members · Nurse · Early bird", 100.0, "GBP"), ("Members · Nurse · Standard", 150.0, "GBP")]
    assert short(got[2]) == []  # one row of three prices: the other has a quantity among them
    assert got[3] == [("Speaker · Early Bird", 399.0, "USD", True, "2026-05-31"), ("Speaker · Final Call", 499.0, "USD", False, None), ("Student · Early Bird", 199.0, "USD", True, "2026-05-31"), ("Student · Final Call", 299.0, "USD", False, None)]
    assert got[4:] == [[], [], [], []]
