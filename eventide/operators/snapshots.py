"""Writes as snapshots: tables and changes in, the next table or the decisions out. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels that say nothing about who pays a price.
GENERIC_LABELS = ("standard", "registration", "registration fee", "fee", "fees", "price", "course fee", "delegate")
# End of fixed values.


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it lacks; of several with one key, the first by all columns."""
    first = rows.groupBy(key).agg(F.min(F.struct(*(c for c in table.columns if c != key))).alias("r")).select(key, "r.*")
    return table.unionByName(first.join(table.select(key), key, "left_anti"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fields: of each row in both, the names of the fields that differ, in their order, joined by commas; rows without any are left out."""
    both = old.alias("o").join(new.alias("n"), key)
    differs = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)))
    return both.select(key, F.array_join(differs, ",").alias("fields")).filter("fields <> ''")


def swap(table: DataFrame, patches: DataFrame, key: str, field: str) -> DataFrame:
    """key, field, done: the field as patched where it still is what the patch expects, else as it was."""
    both = table.select(key, field).join(patches.select(key, "expected", "value"), key)
    fits = F.col(field).eqNullSafe(F.col("expected"))
    return both.select(key, F.when(fits, F.col("value")).otherwise(F.col(field)).alias(field), fits.alias("done"))


def with_evidence(batches: DataFrame) -> DataFrame:
    """Tiers of the events all of whose new tiers have a source of evidence that counts; one without drops the whole batch."""
    sound = F.coalesce(F.col("evidence_identity").isin("own_page", "strong") & (F.col("evidence_url") != ""), F.lit(False))
    good = batches.groupBy("conference_id").agg(F.bool_and(sound).alias("sound")).filter("sound").select("conference_id")
    return batches.join(good, "conference_id", "left_semi")


def fill_tiers(tiers: DataFrame, batches: DataFrame, conferences: DataFrame) -> DataFrame:
    """conference_id, tier_label, price, currency: new tiers with evidence for known events that have none."""
    known = with_evidence(batches).join(conferences.select(F.col("id").alias("conference_id")), "conference_id", "left_semi")
    return known.join(tiers.select("conference_id").distinct(), "conference_id", "left_anti").select("conference_id", "tier_label", "price", F.coalesce("currency", F.lit("GBP")).alias("currency"))


def replace_weak_tiers(tiers: DataFrame, batches: DataFrame) -> DataFrame:
    """conference_id, tier_label, price, currency: new tiers for events whose own are all zero or one of a label that says nothing.

    A new tier needs a label, a price and a currency, and a batch a price over 0.
    """
    plain = F.lower(F.regexp_replace(F.trim(F.min("tier_label")), r"\s+", " "))
    weak = tiers.groupBy("conference_id").agg((F.count_if(F.col("price") == 0) == F.count(F.lit(1))).alias("zero"), ((F.count(F.lit(1)) == 1) & plain.isin(*GENERIC_LABELS)).alias("generic")).filter("zero OR generic").select("conference_id")
    usable = with_evidence(batches).filter((F.trim("tier_label") != "") & (F.col("price") >= 0) & F.col("currency").rlike("^[A-Z]{3}$"))
    paid = usable.filter("price > 0").select("conference_id").distinct()
    return usable.join(weak, "conference_id", "left_semi").join(paid, "conference_id", "left_semi").select("conference_id", "tier_label", "price", "currency")


def mirror(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """The children of the parents that rows have are the rows; those of others stay as they are."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def erase_user(contributions: DataFrame, user: int) -> DataFrame:
    """Without what a user has not published; what is published stays, without its user."""
    mine = F.col("user_id").eqNullSafe(F.lit(user))
    return contributions.filter(~mine | F.col("is_published")).withColumn("user_id", F.when(~mine, F.col("user_id")))


def repaired_cities(conferences: DataFrame, written: DataFrame) -> DataFrame:
    """id, city, action: cleared where the city still is what was written by mistake, else kept."""
    both = conferences.select("id", "city").join(written.select("id", F.col("city").alias("was")), "id")
    same = F.col("city").eqNullSafe(F.col("was"))
    return both.select("id", F.when(~same, F.col("city")).alias("city"), F.when(same, "cleared").otherwise("kept").alias("action"))
