"""Community contributions: published facts over events, moderation counts, duplicate candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.predicates import day, significant_words
from eventide.operators.components import components
from eventide.sources.shared import written


def latest_facts(facts: DataFrame) -> DataFrame:
    """The newest published fact of each event and field; of one day's, the last."""
    newest = facts.filter("is_published").groupBy("conference_id", "field").agg(F.max_by(F.struct("id", "value", "created_on"), F.struct("created_on", "id")).alias("f"))
    return newest.select("conference_id", "field", F.col("f.id").alias("id"), F.col("f.value").alias("value"), F.col("f.created_on").alias("created_on"))


def overlay(events: DataFrame, facts: DataFrame, fields: tuple[str, ...] = ("city", "event_format")) -> DataFrame:
    """Events with facts where the organiser says nothing."""
    wide = latest_facts(facts).groupBy("conference_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"fact_{f}") for f in fields))
    joined = events.select("id", *fields).join(wide.withColumnRenamed("conference_id", "id"), "id", "left")
    return joined.select("id", *(F.coalesce(f, f"fact_{f}").alias(f) for f in fields), F.coalesce(*(F.when(F.col(f).isNull() & F.col(f"fact_{f}").isNotNull(), F.lit(True)) for f in fields), F.lit(False)).alias("from_community"))


def tiers_or_community(events: DataFrame, tiers: DataFrame, community: DataFrame) -> DataFrame:
    """An event's own tiers, or the community's if it has none."""
    own = tiers.select("conference_id", "price", "currency").withColumn("origin", F.lit("organiser"))
    other = community.join(tiers.select("conference_id").distinct(), "conference_id", "left_anti").select("conference_id", "price", "currency").withColumn("origin", F.lit("community"))
    return own.unionByName(other).join(events.select(F.col("id").alias("conference_id")), "conference_id", "left_semi")


def expired_contributions(contributions: DataFrame, conferences: DataFrame, as_of: str) -> DataFrame:
    """Open contributions to events that are archived or over."""
    target = conferences.select(F.col("id").alias("conference_id"), "archived", F.coalesce("end_date", "start_date").alias("last_day"))
    return contributions.join(target, "conference_id", "left").filter(F.col("archived") | (F.col("last_day") < day(as_of))).select("id", "conference_id")


def duplicate_candidates(submitted: DataFrame, events: DataFrame, days: int = 30, words: int = 2) -> DataFrame:
    """Pairs of a submission and an event whose names share some significant words and that start within some days.

    Which names share words is told for names, not for events: the different sets of words that start in a bucket of
    `days` meet those of its own and the neighbours by an inverted index. Events then join the sets that theirs meets, so
    that each pair comes out of one join, once, and is neither shuffled nor counted.
    """
    bucket = F.floor(F.datediff("start_date", F.lit("1970-01-01").cast("date")) / days)

    def said(df: DataFrame, start: str, label: str) -> DataFrame:
        rows = df.filter("start_date IS NOT NULL").select("id", F.col("start_date").alias(start), significant_words("name").alias("words"), bucket.alias("bucket"))
        return rows.filter(F.size("words") >= words).select("id", start, F.array_join(F.array_sort("words"), " ").alias(label), "bucket")

    a = said(submitted, "start_a", "label_a").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    b = said(events, "start_b", "label_b")
    index = lambda df, label: df.select(label, "bucket").distinct().withColumn("word", F.explode(F.split(label, " ")))
    alike = index(a, "label_a").join(index(b, "label_b"), ["word", "bucket"]).groupBy("label_a", "label_b", "bucket").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= words)
    wanted = a.withColumnRenamed("id", "submitted_id").join(alike, ["label_a", "bucket"])
    apart = F.abs(F.datediff("start_a", "start_b"))
    both = wanted.join(b.withColumnRenamed("id", "event_id"), ["label_b", "bucket"]).filter((F.col("submitted_id") != F.col("event_id")) & (apart <= days))
    return both.select("submitted_id", "event_id", "shared", apart.cast("long").alias("days_apart"))


def _alike(nodes: DataFrame, days: int, words: int) -> DataFrame:
    """Pairs a, b of nodes (text, label, bucket, first, last, node) that share some words, b's bucket being a's or the next; whether members of the two link.

    They meet by each two words of theirs, so that a single frequent word pairs nothing, and count once, by the first two
    words that they share. Of two nodes in a bucket the text with the smaller id is a; a node is paired with itself too.
    """
    said = F.split("label", " ")
    twos = F.flatten(F.transform("words", lambda w, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda v: F.concat_ws(" ", w, v))))
    met = nodes.withColumn("words", said).withColumn("two", F.explode(twos)).drop("label")
    side = lambda x: met.select("two", *(F.col(c).alias(f"{c}_{x}") for c in met.columns if c != "two"))
    a = side("a").withColumn("bucket_b", F.explode(F.array(F.col("bucket_a"), F.col("bucket_a") + 1)))
    both = F.array_intersect("words_a", "words_b")
    once = (F.array_join(F.slice(both, 1, 2), " ") == F.col("two")) & (F.size(both) >= words)
    pairs = a.join(side("b"), ["two", "bucket_b"]).filter(once & ((F.col("bucket_a") < F.col("bucket_b")) | (F.col("text_a") <= F.col("text_b"))))
    # days of one text within a bucket all link; those of neighbours do if the nearest do
    return pairs.filter(F.col("first_b") - F.col("last_a") <= days).select("text_a", "bucket_a", "node_a", "text_b", "bucket_b", "node_b")


def duplicate_classes(events: DataFrame, days: int = 30, words: int = 2) -> DataFrame:
    """id, class_id, component_id, links of every event, over the links that `duplicate_candidates` gives of events with themselves.

    class_id is the smallest id of the events that start on the same day and have the same significant words: those link
    the same events. component_id is the smallest id that an event reaches by links, links the number of its own. An event
    without a start or with fewer words is alone. Ids are unique, words at least 2.

    No pair of events is formed. Texts (different sets of words) are paired once for each bucket of `days` in which they
    start; a text's links on a day are the events of all texts paired with it on the days about, summed by a window. All
    events of a text in a bucket link one another, so components are found among texts in buckets.
    """
    start = F.datediff("start_date", F.lit("1970-01-01").cast("date"))
    told = events.select("id", start.alias("day"), F.array_sort(significant_words("name")).alias("words"))
    said = written(told.select("id", "day", F.when(F.col("day").isNotNull() & (F.size("words") >= words), F.array_join("words", " ")).alias("label")), "duplicates-said")
    known = said.filter("label IS NOT NULL")
    classes = known.groupBy("label", "day").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("day") / max(days, 1)))
    classes = written(classes.join(classes.groupBy("label").agg(F.min("class_id").alias("text")), "label"), "duplicates-classes")
    nodes = classes.groupBy("text", "label", "bucket").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.min("class_id").alias("node"))
    # a text's buckets that link one after the other are one node: that of their smallest id
    own = Window.partitionBy("text").orderBy("bucket")
    nodes = nodes.withColumn("apart", F.col("first") - F.lag("last").over(own) > days).withColumn("run", F.count_if("apart").over(own))
    nodes = nodes.withColumn("node", F.min("node").over(Window.partitionBy("text", "run"))).drop("apart", "run")
    alike = written(_alike(nodes, days, words), "duplicates-alike")

    named = components(alike.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    named = nodes.select("text", "bucket", "node").join(named, "node", "left").select("text", "bucket", F.coalesce("component", "node").alias("component_id"))
    ways = alike.selectExpr("text_a AS text", "text_b AS other", "bucket_b AS bucket").union(alike.select("text_b", "text_a", "bucket_a")).distinct()
    about = ways.join(classes.select(F.col("text").alias("other"), "bucket", "day", "n"), ["other", "bucket"]).groupBy("text", "day").agg(F.sum("n").alias("n"))
    near = about.select("text", "day", F.sum("n").over(Window.partitionBy("text").orderBy("day").rangeBetween(-days, days)).alias("near"))
    full = classes.join(near, ["text", "day"]).join(named, ["text", "bucket"]).select("label", "day", "class_id", "component_id", (F.col("near") - 1).alias("links"))
    alone = said.filter("label IS NULL").select("id", F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    return known.join(full, ["label", "day"]).select("id", "class_id", "component_id", "links").union(alone)


def status_counts(logs: DataFrame) -> DataFrame:
    """source_id with its numbers of runs by status, and all."""
    return logs.groupBy("source_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "blocked")), F.count(F.lit(1)).alias("runs"))
