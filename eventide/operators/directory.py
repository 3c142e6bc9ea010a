"""Directory search: filters, exact totals, stable paging in three sorts, and facets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import predicates as P


def cheapest_tier(tiers: DataFrame) -> DataFrame:
    """conference_id, price_from, price_currency: the lowest price and its currency; ties go to the first currency, then id."""
    return tiers.groupBy("conference_id").agg(F.min("price").alias("price_from"), F.min_by("currency", F.struct("price", "currency", "id")).alias("price_currency"))


def directory_events(conferences: DataFrame, sources: DataFrame, tiers: DataFrame) -> DataFrame:
    """Live events with their society, cheapest price, country guess and price bucket. Prices are summed up before the join."""
    live = conferences.filter(~F.col("archived"))
    named = sources.select(F.col("id").alias("source_id"), "society", "source_name")
    joined = live.join(named, "source_id", "left").join(cheapest_tier(tiers).withColumnRenamed("conference_id", "id"), "id", "left")
    return joined.withColumn("country_guess", P.country_guess()).withColumn("price_bucket", P.price_bucket())


@dataclass(frozen=True)
class Filters:
    """What a visitor asks for; empty lists and None ask for nothing."""

    q: str = ""
    formats: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    specialties: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    societies: tuple[str, ...] = ()
    country: str | None = None
    price: str = "any"
    cpd: bool = False
    abstracts: bool = False
    date_from: str | None = None
    date_to: str | None = None
    sort: str = "date"
    page: int = 1
    page_size: int = 30
    as_of: str = "1998-06-01"
    skip: frozenset[str] = field(default_factory=frozenset)

    def without(self, facet: str) -> Filters:
        return replace(self, skip=self.skip | {facet})


LISTS = {"format": ("formats", "event_format"), "type": ("types", "event_type"), "specialty": ("specialties", "specialty"), "region": ("regions", "region"), "society": ("societies", "society")}


def condition(f: Filters) -> Column:
    """All filters as one predicate, so that it reaches the scan where it can."""
    out = P.overlaps(f.date_from, f.date_to)
    for facet, (name, column) in LISTS.items():
        chosen = getattr(f, name)
        if chosen and facet not in f.skip:
            out = out & F.col(column).isin(*chosen)
    if f.country and "country" not in f.skip:
        out = out & (F.col("country_guess") == f.country)
    if f.price != "any" and "price" not in f.skip:
        out = out & P.price_matches(f.price)
    if f.cpd and "cpd" not in f.skip:
        out = out & F.col("cpd_accredited")
    if f.abstracts:
        out = out & P.abstracts_open(f.as_of)
    said = "".join(c for c in f.q if c not in ',()"\\').strip()
    if said:
        out = out & (F.col("name").ilike(f"%{said}%") | F.col("specialty").ilike(f"%{said}%") | F.col("city").ilike(f"%{said}%"))
    return out


def page(conferences: DataFrame, sources: DataFrame, tiers: DataFrame, f: Filters) -> DataFrame:
    """The rows of one page with the exact total, in a total order.

    Prices of all events are only summed up where a filter or the order needs them; else a page's own are looked up, as
    its societies are. Only a page's rows are sorted in full: each task keeps the rows up to the page's end. By date,
    upcoming events come first by start, then ongoing ones by end; finished ones show in the other sorts only.
    """
    named = sources.select(F.col("id").alias("source_id"), "society", "source_name")
    priced, known = f.price != "any" or f.sort == "price", bool(f.societies)
    rows = conferences.filter(~F.col("archived")).withColumn("country_guess", P.country_guess())
    if priced:
        rows = rows.join(cheapest_tier(tiers).withColumnRenamed("conference_id", "id"), "id", "left")
    if known:
        rows = rows.join(named, "source_id", "left")
    rows = rows.filter(condition(f))
    if f.sort == "date":
        rows = rows.withColumn("bucket", P.date_group(f.as_of)).filter("bucket IS NOT NULL")
        key = F.when(F.col("bucket") == 0, F.col("start_date")).otherwise(F.col("end_date"))
        order = [F.asc("bucket"), F.asc_nulls_last(key), F.asc("id")]
    elif f.sort == "newest":
        order = [F.desc_nulls_first("created_on"), F.asc("id")]
    else:
        order = [F.asc_nulls_last("price_from"), F.asc("id")]
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    first = (f.page - 1) * f.page_size
    shown = rows.orderBy(*order).offset(first).limit(f.page_size)
    shown = shown.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long") + first)  # a page at most
    if not priced:
        own = tiers.join(F.broadcast(shown.select(F.col("id").alias("conference_id"))), "conference_id", "left_semi")  # page_size rows
        shown = shown.join(cheapest_tier(own).withColumnRenamed("conference_id", "id"), "id", "left")
    if not known:
        shown = shown.join(named, "source_id", "left")
    return shown.crossJoin(total)


def from_url(query: str) -> Filters:
    """The filters that a directory link asks for; what it doesn't know, it ignores. Pages go to 1,000, of 100 rows at most."""
    given = {k: v[0] for k, v in parse_qs(query.removeprefix("?"), keep_blank_values=True).items()}
    several = lambda name: tuple(x.strip() for x in given.get(name, "").split(",") if x.strip())
    one = lambda name, known, other: given[name] if given.get(name) in known else other
    number = lambda name: int(float(given[name])) if re.fullmatch(r"[0-9]{1,9}(\.[0-9]*)?", given.get(name, "")) else 0
    iso = lambda name: given[name] if re.fullmatch(r"\d{4}-\d{2}-\d{2}", given.get(name, "")) else None
    dearest = number("maxPrice")
    old_price = "any" if not dearest or dearest > 300 else "under-100" if dearest <= 100 else "under-300"
    base = Filters()
    ends = P.preset_days(given.get("datePreset", ""), base.as_of) or (iso("dateFrom"), iso("dateTo"))
    return Filters(
        q=given.get("q", ""), formats=tuple(x for x in several("format") if x in ("in_person", "online", "hybrid")), types=tuple(x for x in several("type") if x in ("conference", "course", "workshop", "degree")),
        specialties=several("specialty"), regions=several("region"), societies=several("society"), country=one("country", ("uk", "international", "unknown"), None), price=one("price", ("any", "free", "under-100", "under-300"), old_price),
        cpd=given.get("cpd") == "1", abstracts=given.get("abstractsOpen") == "1", date_from=ends[0], date_to=ends[1], sort=one("sort", ("date", "newest", "price"), base.sort), page=min(number("page"), 1000) or base.page, page_size=min(number("pageSize"), 100) or base.page_size,
    )


def to_url(f: Filters) -> str:
    """The link of some filters, without what is at its default; from_url() reads it back."""
    base, lists = Filters(), {"format": f.formats, "type": f.types, "specialty": f.specialties, "region": f.regions, "society": f.societies}
    said = {"q": f.q, "dateFrom": f.date_from, "dateTo": f.date_to, **{k: ",".join(v) for k, v in lists.items()}, "country": f.country, "price": f.price if f.price != base.price else "", "cpd": "1" if f.cpd else "", "abstractsOpen": "1" if f.abstracts else ""}
    said |= {"sort": f.sort if f.sort != base.sort else "", "page": f.page if f.page != base.page else "", "pageSize": f.page_size if f.page_size != base.page_size else ""}
    return urlencode({k: v for k, v in said.items() if v})


def split_page(upcoming: int, page: int, size: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """A page over two groups, one after the other: offset and rows in the first of `upcoming` rows, and in the second."""
    first = (page - 1) * size
    mine = max(0, min(size, upcoming - first))
    return (min(first, upcoming), mine), (max(0, first - upcoming), size - mine)


FACETS = {"format": "event_format", "type": "event_type", "specialty": "specialty", "region": "region", "society": "society", "country": "country_guess", "price": "price_bucket", "cpd": "cpd_accredited"}


def facets(events: DataFrame, f: Filters, wanted: tuple[str, ...] = tuple(FACETS)) -> DataFrame:
    """facet, value, n: the count of every value under all filters but the facet's own; nulls are not values.

    One pass: each row says which of the wanted facets it counts for, is exploded to those, and summed before the shuffle.
    """
    entries = [F.when(condition(f.without(facet)), F.struct(F.lit(facet).alias("facet"), F.col(FACETS[facet]).cast("string").alias("value"))) for facet in wanted]
    rows = events.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*").filter("value IS NOT NULL")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def roll_up(facet_rows: DataFrame, taxonomy: DataFrame, facet: str = "specialty") -> DataFrame:
    """parent, n: raw values summed by their parent, matched exactly, else without regard to case, else ``other``."""
    exact = taxonomy.select(F.col("raw").alias("value"), F.col("parent").alias("p1"))
    loose = taxonomy.groupBy(F.lower("raw").alias("low")).agg(F.min("parent").alias("p2"))
    rows = facet_rows.filter(F.col("facet") == facet).join(exact, "value", "left").withColumn("low", F.lower("value")).join(loose, "low", "left")
    return rows.groupBy(F.coalesce("p1", "p2", F.lit("other")).alias("parent")).agg(F.sum("n").alias("n"))


def with_tiers(events: DataFrame, tiers: DataFrame) -> DataFrame:
    """Events with the ids of their tiers, in order, joined by commas; null without any."""
    own = tiers.groupBy("conference_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("tiers"))  # bounded by one event
    return events.join(own.withColumnRenamed("conference_id", "id"), "id", "left").select("source_url", "id", "tiers")


def tier_list(tiers: DataFrame) -> DataFrame:
    """conference_id, tiers: prices with their currencies, by price, then id."""
    rows = F.array_sort(F.collect_list(F.struct("price", "id", "currency")))  # bounded by one event
    return tiers.groupBy("conference_id").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(" ", x["price"].cast("string"), x["currency"])), ", ").alias("tiers"))
