"""What pages say is read once: what remains to be run reads it back from the shared folder."""

from pyspark.sql import DataFrame

from eventide.operators import fee_matrix, fees, linked_data


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_fee_grids_are_read_once(spark):
    pages = spark.createDataFrame([(1, "Fees\nEarly bird\nLate\nStudent  £5 | £6\nMember  £7 | £8")], "page_id long, text string")
    found = fee_matrix.tiers(pages)
    assert "regexp_extract_all" not in plan(found) and found.count() == 4


def test_cells_of_fee_tables_are_read_once(spark):
    html = "<h2>Registration fees</h2><table><tr><th>Category</th><th>Early</th><th>Late</th></tr><tr><td>Member</td><td>£5</td><td>£6</td></tr></table>"
    found = fees.tiers(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert "translate(" not in plan(found) and found.count() == 2


def test_offers_are_read_once(spark):
    html = '<script type="application/ld+json">{"@type":"Event","offers":[{"price":5,"priceCurrency":"GBP"}]}</script>'
    found = linked_data.tiers(linked_data.events(spark.createDataFrame([(1, html)], "page_id long, html string")))
    assert "variant_get" not in plan(found) and found.count() == 1
