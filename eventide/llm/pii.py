"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seed entities (e-mail and IP addresses, card and phone numbers) are found by their form. The words around them induce
lexical patterns; patterns and the values that stand in them make a graph, whose scores Spark computes in rounds; what
stands in a pattern of high confidence is found too, though its form alone would not tell.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import materialize, unused

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats and the conditions before and after find the same leftmost matches as the plain expressions
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+  [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)  [0-9]([\x20-]?[0-9])+
# \+[0-9][\x20().0-9-]+[0-9] but need neither a stack nor a second look at long runs; card runs of other lengths than 12 to 19 digits fail anyway.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a pattern may discover: a run of tokens that each have a digit or an at sign, with single spaces and signs of phone
#: numbers between them. A card or phone number never reaches beyond one, nor does what has no white space.
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++(?:\x20[\x20().-]*+(?=[^\s0-9@]*+[0-9@])\S++)*+"
#: Punctuation before and after a run does not belong to it.
EDGE, CORE = r"^[^\p{L}\p{N}@+]*+", r"(?s)[\p{L}\p{N}@+](?:.*[\p{L}\p{N}@])?"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The two words before a value and the word after it, whatever punctuation clings to the value.
LEFT = r"(?<!\S)(\S++\s++\S++)\s++[^\s\p{L}\p{N}@]*+$"
RIGHT = r"^[^\s\p{L}\p{N}@]*+\s++(\S++)"
SPAN = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"
#: Elements of a block. A fold copies what it holds at each step, so that long arrays are folded block by block.
BLOCK = 128


def _may(kind: str, text: Column) -> Column:
    """A cheap test that skips texts without any match."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "token": text.rlike("[0-9@]")}[kind]


def _in_blocks(items: Column) -> Column:
    """A column's array cut into arrays of BLOCK elements. The column must not be an expression, which every block would compute."""
    none = F.array().cast("array<bigint>")
    return F.transform(F.when(F.size(items) > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.size(items) - 1) / BLOCK))).otherwise(none), lambda i: F.slice(items, (i * BLOCK + 1).cast("int"), BLOCK))


def _running(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The results of op over each number and all before it, from 0: of a short array."""
    return F.slice(F.aggregate(numbers, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))), 2, F.greatest(F.size(numbers), F.lit(1)))


def _all_running(blocks: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The same of a long array, from the running results of its blocks: what op gives for all before a block goes into each."""
    before = F.concat(F.array(F.lit(0)), _running(F.transform(blocks, lambda b: F.element_at(b, -1)), op))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, o: F.transform(b, lambda x: op(x, o))))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(kind: str, zipped: Column, ends: Column) -> Column:
    """Matches (m, before, after) with their places in code points; of the runs of tokens what is within EDGE."""

    def span(x: Column, end: Column) -> Column:
        value, start = x["m"], end - F.length(x["m"])
        if kind == "token":
            value, start = F.regexp_extract(x["m"], CORE, 0), start + F.length(F.regexp_extract(x["m"], EDGE, 0))
        left = F.regexp_replace(F.regexp_extract(F.lower(x["before"]), LEFT, 1), r"\s+", " ")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), left.alias("left"), F.regexp_extract(F.lower(x["after"]), RIGHT, 1).alias("right"))

    return F.zip_with(zipped, ends, span)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda value: value.isNotNull(),
    "ip": lambda value: value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
    "card": lambda value: _luhn(value),
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
}


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda x: VALID[kind](x["value"])


def mentions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, tag (hash of the text), base (the seed entities) and others (what may be discovered) of every row.

    Others are runs of tokens with a digit or an at sign each, without punctuation at their ends, that hold no seed entity.
    """
    text = F.col("body")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    forms = FORMS | {"token": TOKEN}
    holds = lambda x: reduce(or_, (F.exists(F.regexp_extract_all(x["value"], F.lit(rx), F.lit(0)), VALID[k]) for k, rx in FORMS.items()))
    rows = rows.select(
        "id",
        F.xxhash64("body").alias("tag"),
        *(F.when(_may(k, text), F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{k}") for k, rx in forms.items()),
        *(F.when(_may(k, text), F.split(text, rx, -1)).otherwise(F.array().cast("array<string>")).alias(f"p_{k}") for k, rx in forms.items()),
    )
    zipped = lambda k: F.arrays_zip(F.col(f"m_{k}").alias("m"), F.slice(f"p_{k}", 1, F.size(f"m_{k}")).alias("before"), F.slice(f"p_{k}", 2, F.size(f"m_{k}")).alias("after"))
    # each step's columns are used more than once in the next, which keeps them from being computed again for each block
    rows = rows.select("id", "tag", *(zipped(k).alias(f"z_{k}") for k in forms), *(F.transform(zipped(k), lambda x: F.length(x["before"]) + F.length(x["m"])).alias(f"n_{k}") for k in forms))
    rows = rows.select("id", "tag", *(f"z_{k}" for k in forms), *(F.transform(_in_blocks(F.col(f"n_{k}")), lambda b: _running(b, _add)).alias(f"b_{k}") for k in forms))
    rows = rows.select("id", "tag", *(_spans(k, F.col(f"z_{k}"), _all_running(F.col(f"b_{k}"), _add)).alias(f"s_{k}") for k in forms))
    base = F.concat(*(F.filter(f"s_{k}", _valid(k)) for k in KINDS))
    return rows.select("id", "tag", base.alias("base"), F.filter("s_token", lambda x: x["value"].rlike("[0-9@]") & ~holds(x)).alias("others"))


ROUNDS, LEAST_SCORE, LEAST_VALUES = 3, 0.8, 3


def discover(found: DataFrame, rounds: int = ROUNDS, least: float = LEAST_SCORE, values: int = LEAST_VALUES) -> DataFrame:
    """id, tag, extra: the spans that patterns of high confidence add.

    A pattern is the two words before a value, or the word before and the word after. Its score for a kind is the mean
    score of the distinct values that stand in it, seeds having 1 and others what their best pattern gave them in the
    round before; it counts with `values` known values and a score of `least`. The graph has an edge for each pattern
    and value, so that repeated copies weigh nothing and hot patterns are summed before they are shuffled.
    """
    seeds = found.select(F.explode("base").alias("s")).select("s.*")
    loose = found.select("id", "tag", F.explode("others").alias("s")).select("id", "tag", "s.*")

    def patterns(df: DataFrame) -> DataFrame:
        last = F.regexp_extract("left", r"(\S+)$", 1)
        both = F.array(F.when(F.col("left") != "", F.concat(F.lit("2 "), "left")), F.when((last != "") & (F.col("right") != ""), F.concat(F.lit("1 "), last, F.lit(" _ "), "right")))
        return df.withColumn("pattern", F.explode(F.array_compact(both)))

    edges = patterns(seeds).select("pattern", F.md5("value").alias("value"), "kind").union(patterns(loose).select("pattern", F.md5("value").alias("value"), F.lit("").alias("kind"))).distinct()
    # Only patterns with enough values, seeds or not, can ever count; the rest of the graph is left here.
    rich = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= values).select("pattern")
    edges = materialize(edges.join(rich, "pattern", "left_semi"), "pii-edges")
    scores = edges.filter("kind <> ''").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    best = None
    for _ in range(rounds):
        known = edges.select("pattern", "value").distinct().join(scores, "value", "left")
        total = known.groupBy("pattern").agg(F.count_distinct("value").alias("all"))
        weight = known.filter("kind is not null").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"))
        best = materialize(weight.join(total, "pattern").withColumn("score", F.col("sum") / F.col("all")).filter((F.col("n") >= values) & (F.col("score") >= least)).select("pattern", "kind", "score"), "pii-patterns")
        given = edges.select("pattern", "value").distinct().join(best, "pattern").select("value", "kind", "score")
        seeded = edges.filter("kind <> ''").select("value", "kind", F.lit(1.0).alias("score"))
        scores = materialize(given.union(seeded).groupBy("value", "kind").agg(F.max("score").alias("score")), "pii-scores")
    hits = patterns(loose).select("id", "tag", "start", "end", "pattern").join(best, "pattern")
    one = hits.groupBy("id", "tag", "start", "end").agg(F.max(F.struct("score", "kind")).alias("top"))
    return one.groupBy("id", "tag").agg(F.collect_set(F.struct(F.col("top.kind").alias("kind"), "start", "end")).alias("extra"))  # bounded by one text's tokens


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def extract(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, tag (hash of the text), base and spans of every row: arrays of kind, start and end, in code points.

    base holds the seed entities, leftmost and non-overlapping for each kind; spans also what the patterns add, never
    within a base span. A null or empty text has none. Repeated rows give a row each, with like results; null ids are
    allowed; other columns are left out; an empty table gives an empty one.
    """
    found = materialize(mentions(docs, text_col, id_col), "pii-mentions")
    extra = discover(found)
    slim = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = found.select("id", "tag", slim(F.col("base")).alias("base")).alias("f")
    extra = extra.select(F.col("id").alias("id2"), F.col("tag").alias("tag2"), "extra")
    rows = rows.join(extra, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2")), "left")
    return rows.select(F.col("id").alias(id_col), "tag", "base", F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def summary(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns n_email, n_ip, n_card, n_phone, base_sha256, spans (as a string) and n_spans (all of them) of extract()."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(id_col, *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All rows and columns, with every span in the text replaced by ``[KIND]``; overlapping spans are one, under the kind of the first.

    The text is cut at the spans, so the rest of it stays as it is. A null text stays null.
    """
    own_id, own_tag, cuts, tag = (unused(docs, n) for n in ("_id", "_tag", "_spans", "_hash"))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    spans = extract(docs, text_col, id_col).filter(F.size("spans") > 0).select(F.col(id_col).alias(own_id), F.col("tag").alias(own_tag), ordered.alias(cuts)).dropDuplicates([own_id, own_tag])
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(tag, F.xxhash64(body)).join(spans, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(tag) == F.col(own_tag)), "left")

    ends, parts, blocks = (unused(docs, n) for n in ("_ends", "_parts", "_blocks"))
    rows = rows.withColumn(ends, F.transform(cuts, lambda x: x["end"]))
    rows = rows.withColumn(blocks, F.transform(_in_blocks(F.col(ends)), lambda b: _running(b, F.greatest)))

    def part(x: Column, end: Column, at: Column) -> Column:
        """What is kept before a span, and its mark; a span that begins within another one has neither."""
        fresh = x["start"] >= at
        mark = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(at.alias("from"), F.when(fresh, x["start"]).otherwise(at).alias("to"), F.when(fresh, mark).otherwise("").alias("mark"), end.alias("end"))

    reached = _all_running(F.col(blocks), F.greatest)
    rows = rows.withColumn(ends, reached).withColumn(parts, F.zip_with(F.zip_with(cuts, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end"))), F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(cuts) - 1, F.lit(0)))), lambda y, at: part(y["x"], y["end"], at)))

    def said(block: Column) -> Column:
        """A block's text is taken out of the whole once, and its parts out of that."""
        first = block[0]["from"]
        whole = F.substr(F.col(text_col), first + 1, F.element_at(block, -1)["to"] - first)
        return F.transform(F.array(whole), lambda w: F.array_join(F.transform(block, lambda x: F.concat(F.substr(w, x["from"] - first + 1, x["to"] - x["from"]), x["mark"])), ""))[0]

    last = F.substr(F.col(text_col), F.element_at(F.col(parts), -1)["end"] + 1, F.length(text_col))
    cut = F.concat(F.array_join(F.transform(_in_blocks(F.col(parts)), said), ""), last)
    return rows.withColumn(text_col, F.when(F.col(cuts).isNotNull(), cut).otherwise(F.col(text_col))).select(*docs.columns)
