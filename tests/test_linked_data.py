"""JSON-LD on written pages: nested graphs, lists, broken blocks, offers of every form."""

from eventide.operators import linked_data as ld


def page(*blocks):
    return "<html>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</html>"


def frame(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(2)


def names(spark, pages):
    found = ld.events(frame(spark, pages)).orderBy("page_id", "place").collect()
    return [[r["name"] for r in found if r.page_id == k] for k in range(len(pages))]


def test_events(spark):
    pages = [
        page('{"@type": "Event", "name": "A"}'), page('{"@graph": [{"@type": "WebPage", "name": "x"}, {"@type": "MedicalEvent", "name": "A"}]}'), page('[{"@type": "Event", "name": "A"}, [[{"@type": ["Thing", "EducationEvent"], "name": "B"}]]]'),
        page('{"@type": "Event", "name": "A", "subEvent": [{"@type": "Event", "name": "B", "event": {"@type": "Event", "name": "C"}}]}'), page('{"@type": "Event", "name": "A"', '{"@type": "Event", "name": "B"}'),
        page("{&quot;@type&quot;: &quot;Event&quot;, &quot;name&quot;: &quot;A &amp; B&quot;}"), page('{"@type": "Eventual", "name": "A"}', '"Event"', "7", "null", "[]", '{"@graph": null}', '{"name": "Event"}'), "<script>var x = {}</script>", "", None,
        page('{"@graph": ' * 12 + '{"@type": "Event", "name": "deep"}' + "}" * 12), "<SCRIPT TYPE='application/ld+json' id=x>{\"@type\": \"Event\", \"name\": \"A\"}</SCRIPT>",
    ]
    assert names(spark, pages) == [["A"], ["A"], ["A", "B"], ["A", "B", "C"], ["B"], ["A & B"], [], [], [], [], ["deep"], ["A"]]
    assert ld.events(frame(spark, pages).limit(0)).collect() == []


def test_offers(spark):
    offers = [
        '[{"name": "Member", "price": "150.00", "priceCurrency": "GBP"}, {"name": "Non-member", "price": 250, "priceCurrency": "GBP"}, {"name": "Early Bird", "price": 99.5, "priceCurrency": "gbp"}, {"name": "Member", "price": 150, "priceCurrency": "GBP"}]',
        '{"lowPrice": "1.200,00", "priceCurrency": "€", "description": "<b>All</b>  days"}', '{"price": 0, "priceCurrency": "EUR"}', '{"price": "20"}', '[{"price": "TBC", "priceCurrency": "EUR"}, null, 7, {"category": "Guest", "price": 20, "priceCurrency": "SEK"}]', "null",
    ]
    pages = [page(f'{{"@type": "Event", "name": "A", "startDate": "2026-10-12T09:00", "endDate": "2026-10-14", "offers": {o}}}') for o in offers]
    found = ld.events(frame(spark, pages))
    assert {(str(r["first"]), str(r["last"])) for r in found.collect()} == {("2026-10-12", "2026-10-14")}
    rows = ld.tiers(found).orderBy("page_id", "place").collect()
    got = [[(r.label, r.price, r.currency, r.early) for r in rows if r.page_id == k] for k in range(len(pages))]
    assert got == [
        [("Registration · Member", 150.0, "GBP", False), ("Registration · Non-member", 250.0, "GBP", False), ("Registration · Early Bird", 99.5, "GBP", True)],
        [("Registration · All days", 1200.0, "EUR", False)], [("Registration · Free", 0.0, "EUR", False)], [], [("Registration · Guest", 20.0, "SEK", False)], [],
    ]
    assert [r.label for r in ld.tiers(found, default_currency="GBP").filter("page_id = 3").collect()] == ["Registration · Standard"]
