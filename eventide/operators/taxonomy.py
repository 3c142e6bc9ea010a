"""Specialties and societies: raw values, their parents, and what a profile or a code stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(parents: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """slug, raws: every raw value of the parents asked for, in order, joined by commas; none for an unknown one."""
    raws = taxonomy.groupBy(F.col("parent").alias("slug")).agg(F.array_join(F.array_sort(F.collect_set("raw")), ",").alias("raws"))  # bounded by the taxonomy
    return parents.join(raws, "slug", "left").select("slug", F.coalesce("raws", F.lit("")).alias("raws"))


def of_profiles(profiles: DataFrame, taxonomy: DataFrame, column: str = "specialty") -> DataFrame:
    """user_id, raws: what events a profile's specialty stands for: a parent's raw values, or those of a raw value's parent; ``other`` and unknown ones stand for none."""
    low = F.lower(F.col(column))
    parents = taxonomy.select(F.col("parent").alias("key"), "parent").union(taxonomy.select(F.lower("raw"), "parent")).filter("key <> 'other'").groupBy("key").agg(F.min("parent").alias("slug"))
    named = profiles.select("user_id", low.alias("key")).join(parents, "key", "left")
    return expand(named.select("slug").dropna().distinct(), taxonomy).join(named, "slug", "right").select("user_id", F.coalesce("raws", F.lit("")).alias("raws"))


def unmapped(profiles: DataFrame, taxonomy: DataFrame, events: DataFrame) -> DataFrame:
    """user_id, events: for users whose specialty the taxonomy lacks, the events whose specialty equals it without regard to case."""
    known = taxonomy.select(F.lower("raw").alias("key")).union(taxonomy.select("parent")).distinct()
    lost = profiles.filter("specialty IS NOT NULL").select("user_id", F.lower("specialty").alias("key")).join(known, "key", "left_anti")
    return lost.join(events.groupBy(F.lower("specialty").alias("key")).agg(F.count(F.lit(1)).alias("events")), "key").select("user_id", "events")


def info(codes: DataFrame, societies: DataFrame) -> DataFrame:
    """code, name, kind, country: of every code, unknown ones under their own name as other; a null code is left out."""
    both = codes.filter("code IS NOT NULL").join(societies, "code", "left")
    return both.select("code", F.coalesce("name", "code").alias("name"), F.coalesce("kind", F.lit("other")).alias("kind"), F.coalesce("country", F.lit("Unknown")).alias("country"))


def missing(sources: DataFrame, societies: DataFrame) -> DataFrame:
    """source_id, society: active sources whose society, other than Community, is not among the known ones."""
    named = sources.filter(F.col("active") & (F.trim("society") != "") & (F.col("society") != "Community")).select(F.col("id").alias("source_id"), "society")
    return named.join(societies.select(F.col("code").alias("society")), "society", "left_anti").select("source_id", "society")


def by_kind(codes: DataFrame, societies: DataFrame) -> DataFrame:
    """kind, names: the names of each kind of society, in order."""
    return info(codes, societies).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def featured(counts: DataFrame, chosen: list[str], limit: int = 8) -> DataFrame:
    """society, n, place: the chosen ones that have events, in their order; if none has, the largest."""
    rank = F.array_position(F.array(*map(F.lit, chosen)), F.col("society")) if chosen else F.lit(0)
    rows = counts.filter("n > 0").withColumn("place", rank.cast("long"))
    some = rows.filter("place > 0")
    none = some.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    rest = rows.crossJoin(none).filter("none").orderBy(F.desc("n"), "society").limit(limit).select("society", "n", F.lit(0).cast("long").alias("place"))  # a scalar beside each row
    return some.select("society", "n", "place").orderBy("place").limit(limit).union(rest)
