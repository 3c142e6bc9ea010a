"""JSON-LD on pages: events found anywhere in nested graphs, and the tiers that their offers name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import money, texts
from eventide.sources.shared import written

# Keys whose values may hold further nodes, and what makes a node an event.
KEYS = ["@graph", "subEvent", "event"]
EVENT = "Event$"
# End of fixed values.

SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json\b[^>]*>(.*?)</script"""
REFERENCES = {"&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _text(v: Column, *path: str) -> Column:
    """A value of a node as text; null if it is absent, null, or not a scalar."""
    return F.try_variant_get(v, "$" + "".join(f'["{k}"]' for k in path), "string")


def _part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def _sort(v: Column) -> Column:
    """array, object or scalar."""
    said = F.schema_of_variant(v)
    return F.when(said.startswith("ARRAY"), "array").when(said.startswith("OBJECT"), "object").otherwise("scalar")


def _elements(arrays: DataFrame, column: str) -> DataFrame:
    """A row for each element of an array. The order within the page is kept in place."""
    kept = [F.col(c) for c in arrays.columns if c not in (column, "place")]
    elements = F.explode_outer(F.transform(F.variant_get(column, "$", "array<variant>"), lambda v, i: F.struct(i.alias("i"), v.alias("v"))))
    return arrays.select(*kept, "place", elements.alias("e")).filter("e IS NOT NULL").select(*kept, F.concat("place", F.array("e.i")).alias("place"), F.col("e.v").alias(column))


def _items(rows: DataFrame, column: str) -> DataFrame:
    """A row for each element of an array; any other value stays as it is."""
    arrays, others = rows.filter(_sort(F.col(column)) == "array"), rows.filter(_sort(F.col(column)) != "array")
    return _elements(arrays, column).unionByName(others)


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, place, node (variant): every object that a page's JSON-LD holds, at any depth of lists and of the keys for graphs and parts.

    Blocks that are no JSON, and values that are null, are left out. place orders a page's nodes; the walk goes on, a
    round for each level of nesting, until nothing is left to open; each round is written to the shared folder.
    """
    plain = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REFERENCES.items(), F.col("block"))
    # an outer explode, and no filter on what is parsed: Spark would do both twice to test them. Blocks that are no JSON go with the first round
    blocks = pages.select(F.col(id_col).alias("id"), F.posexplode_outer(F.regexp_extract_all(F.col(html_col), F.lit(SCRIPT), F.lit(1))).alias("i", "block")).filter("block IS NOT NULL")
    front = blocks.select("id", F.array("i").alias("place"), F.coalesce(F.try_parse_json("block"), F.try_parse_json(plain)).alias("node"))
    found = []
    while True:
        # told once a node: it goes through all of it
        front = written(front.withColumn("sort", _sort(F.col("node"))), "linked-data").filter("sort <> 'scalar'")
        if front.isEmpty():
            break
        objects = front.filter("sort = 'object'").drop("sort")
        found.append(objects)
        below = F.explode(F.array(*(F.struct(F.lit(k).alias("i"), _part(F.col("node"), key).alias("v")) for k, key in enumerate(KEYS))))
        deeper = objects.select("id", "place", below.alias("e")).filter("e.v IS NOT NULL").select("id", F.concat("place", F.array("e.i")).alias("place"), F.col("e.v").alias("node"))
        front = _elements(front.filter("sort = 'array'").drop("sort"), "node").unionByName(deeper)
    if not found:
        return front.select("id", "place", "node")
    return reduce(DataFrame.unionByName, found)


def events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, place, node, name, first, last: the nodes whose type, or one of whose types, ends with Event."""
    kinds = F.coalesce(F.try_variant_get(F.col("node"), '$["@type"]', "array<string>"), F.array(_text(F.col("node"), "@type")))
    rows = nodes(pages, id_col, html_col).filter(F.exists(kinds, lambda k: k.rlike(EVENT)))
    day = lambda key: texts.safe_date(F.left(_text(F.col("node"), key), F.lit(10)))
    return rows.select(F.col("id").alias(id_col), "place", "node", _text(F.col("node"), "name").alias("name"), day("startDate").alias("first"), F.coalesce(day("endDate"), day("startDate")).alias("last"))


def tiers(events: DataFrame, id_col: str = "page_id", default_currency: str | None = None) -> DataFrame:
    """id, place, label, price, currency, early: the tiers of events' offers, one object or several.

    The price is the offer's, or its lowest; without one, or one that is no number, or a currency that is known, it is
    no tier. A label is the offer's name, category or description, up to 70 characters, else Free or Standard. Equal
    tiers of an event are one.
    """
    offers = written(events.select(F.col(id_col).alias("id"), F.col("place").alias("event"), "place", _part(F.col("node"), "offers").alias("offer")), "offers")
    o = _items(offers, "offer").filter(_sort(F.col("offer")) == "object")
    price = texts.parse_number(F.coalesce(_text(F.col("offer"), "price"), _text(F.col("offer"), "lowPrice")))
    code = F.coalesce(money.currency(_text(F.col("offer"), "priceCurrency")), F.lit(default_currency).cast("string"))
    said = F.coalesce(*(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(_text(F.col("offer"), k), "<[^>]*>", " "), r"\s+", " ")), F.lit("")) for k in ("name", "category", "description")))
    # read once and written before anything is filtered by it
    o = written(o.select("id", "event", "place", price.alias("price"), code.alias("currency"), said.alias("said")), "offers-read").filter("price IS NOT NULL AND currency IS NOT NULL")
    name = F.coalesce("said", F.when(F.col("price") == 0, "Free").otherwise("Standard"))
    o = o.select("id", "event", "place", F.concat(F.lit("Registration · "), F.left(name, F.lit(70))).alias("label"), "price", "currency", name.rlike(r"(?i)early[\s-]?bird").alias("early"))
    first = F.row_number().over(Window.partitionBy("id", "event", "label", "price", "currency").orderBy("place"))
    return o.withColumn("again", first).filter("again = 1").select(F.col("id").alias(id_col), "place", "label", "price", "currency", "early")
