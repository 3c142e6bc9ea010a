"""Fee grids in running text: lines of labels, times and prices, aligned by where they stand.

Every line is one row, told by what it holds: prices alone, a time such as an early-bird date, a label, or a label or time
with prices behind it. Lines of prices belong to the line above them. What is a header, a group or a row then follows from
the runs in which lines stand, found by windows over each page's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import money, texts
from eventide.sources.shared import written

# Cells without a price, times that a price holds for, words of groups and headings, and words that are no acronyms.
NO_PRICE = r"(?:-+|–|—|n/?a|free|tb[ac]|incl\.?|included)"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
TIME = r"(?i)^(?:(?:by|before|until|till|up\s+to|after|from|on|until)\s+[^\n]{1,30}|(?:super[\s-]?)?early[\s-]?bird(?:\s+\w+){0,3}|late(?:\s+\w+){0,2}|standard(?:\s+\w+)?|regular(?:\s+\w+)?|on[\s-]?site(?:\s+\w+)?|advance(?:\s+\w+)?|final(?:\s+\w+)?)\W*$"
TIME_WORD, TIME_SAYS = r"(?i)^(?:by|before|until|till|up\s+to|after|from|on)\b", rf"(?i)\d|\b{MONTH}\b|deadline|date|congress|meeting|event|registration"
GROUP = r"(?i)\bmembers?\b|non[\s-]?members?|\bdelegates?\b|\bgroup\b|\bfull\b\s+rate"
HEADING = r"(?i)\b(?:fees?|registration|prices?|pricing|rates?|tickets?)\b"
PLAIN_WORDS = ["members", "member", "non", "non-members", "non-member", "delegates", "delegate", "group", "full", "rate", "rates", "fees", "fee"]
EARLY = r"(?i)early|advance|by\b|before|until"
TAB_HEAD, TAB_SKIP = r"(?i)^(registration\s*type|ticket\s*type|category$)", r"(?i)^(?:qty|quantity|registration\s*type|ticket\s*type|category|type|price|fees?)$"
# End of fixed values.

#: Prices that make a grid; lines above a tabbed grid that may name its columns.
LEAST, ABOVE = 4, 8
_CELL = rf"{money.AMOUNT}|(?i:(?<![^\s|/]){NO_PRICE}(?=[\s|/]|$))"
#: Lines whose currencies all follow their figures are read figure by figure.
_SUFFIXED = rf"{money.FIGURE}{money.NO_CENTS}?\s*{money.TOKEN}|(?i:(?<![^\s|/]){NO_PRICE}(?=[\s|/]|$))"

_MARKED = rf"(?:(?:{money.TOKEN}\s{{0,4}}){{1,2}}{money.FIGURE}{money.NO_CENTS}?(?:\s{{0,4}}{money.TOKEN}(?!\s*\d))?|{money.FIGURE}{money.NO_CENTS}?\s{{0,4}}{money.TOKEN}(?!\s*\d))"


def cells(line: Column) -> Column:
    """The prices of a line that holds nothing else: array of structs of amount and currency, both null for a cell without a price; null for any other line."""

    none = F.struct(F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency"))

    def price(said: Column) -> Column:
        known = lambda p: F.when(p["high"].isNull() & p["currency"].isNotNull(), F.struct(p["amount"].alias("amount"), p["currency"].alias("currency")))
        return F.when(said.rlike(rf"(?i)^{NO_PRICE}$"), none).otherwise(money._once(F.get(money.found(said), 0), known))

    def said(pattern: str) -> Column:
        """The line's cells; whether it begins with one is looked at first, whether it holds anything else next."""
        alone = line.rlike(rf"^[\s|/]*(?:{pattern})") & F.regexp_replace(line, pattern, "").rlike(r"^[\s|/]*$")
        return F.when(alone, F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))

    suffixed = line.rlike(rf"^[\s|/]*(?:(?:{_SUFFIXED})[\s|/]*)+$")
    may = line.rlike(r"\d") | line.rlike(rf"(?i)^[\s|/]*{NO_PRICE}(?:[\s|/]+{NO_PRICE})*[\s|/]*$")
    prices = F.transform(F.when(may, F.when(suffixed, said(_SUFFIXED)).otherwise(said(_CELL))), price)
    return money._once(prices, lambda all_of: F.when((F.size(all_of) > 0) & F.forall(all_of, lambda x: x.isNotNull()), all_of))


def is_time(line: Column) -> Column:
    """A line that says when a price holds, such as By July 15th, Early bird or Late."""
    s = F.regexp_replace(F.trim(line), ":+$", "")
    return (F.length(s).between(1, 40)) & s.rlike(TIME) & (~s.rlike(TIME_WORD) | s.rlike(TIME_SAYS))


def _tidy(part: Column) -> Column:
    """Trimmed; of words all in capitals the plain ones are written small but for their first letter."""
    words = F.transform(F.split(part, r"\s+"), lambda w: F.when(F.lower(w).isin(*PLAIN_WORDS), F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))).otherwise(w))
    shown = F.when((part == F.upper(part)) & (part != F.lower(part)), F.array_join(words, " ")).otherwise(part)
    return F.regexp_replace(shown, r"^[ :\-–|*]+|[ :\-–|*]+$", "")


def _label(*parts: Column) -> Column:
    return F.left(F.array_join(F.filter(F.array(*(_tidy(F.coalesce(p, F.lit(""))) for p in parts)), lambda p: p != ""), " · "), F.lit(200))


def lines(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, at, line: the lines of each text that are not blank, tabs kept, in order."""
    plain = F.translate(F.col(text_col), " ​", " ")
    split = F.transform(F.split(plain, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^[ ]+|[ ]+$", ""))
    return pages.select(F.col(id_col).alias("id"), F.posexplode(F.filter(split, lambda x: ~x.rlike(r"^\s*$"))).alias("at", "line"))


def _read(rows: DataFrame) -> DataFrame:
    """id, at, line, cells, tail, parts, priced, row: each line with the prices that it holds alone, behind something else, or between tabs.

    Every line is read once and written to the shared folder, as all sorts of grids begin with it.
    """
    # where prices begin on a line: at its first figure with a currency, before it or, all along the line, behind it
    none = rf"(?i:(?<![^\s|/]){NO_PRICE}(?=[\s|/]|$))"
    begins = [F.regexp_instr("line", F.lit(rf"(?:{none}[\s|/]+)*(?:{one})(?:[\s|/]*(?:{one}|{none}))*[\s|/]*$")) for one in (_MARKED, _SUFFIXED)]
    parts = F.filter(F.transform(F.split("line", "\t"), lambda p: F.trim(p)), lambda p: p != "")
    tabbed = (F.size(parts) > 2) & (F.length(parts[0]) <= 80) & parts[0].rlike("[A-Za-z]{3}") & F.col("line").contains("\t")
    of_tabs = F.when(tabbed, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " "))

    def tail(texts: Column) -> Column:
        """Of the two places the first from which there are prices alone."""
        tries = F.transform(texts, lambda at: F.when(at > 1, money._once(cells(F.substr("line", at)), lambda c: F.when(c.isNotNull(), F.struct(at.alias("at"), c.alias("cells"))))))
        return F.get(F.array_compact(tries), 0)

    read = rows.select("id", "at", "line", parts.alias("parts"), of_tabs.alias("of_tabs"), cells(F.col("line")).alias("cells"))
    behind = F.when(F.col("cells").isNull() & F.col("line").rlike(r"\d"), F.array_distinct(F.array(*begins)))
    read = read.select("id", "at", "line", "cells", "parts", tail(behind).alias("tail"), cells(F.col("of_tabs")).alias("priced"))
    row = (F.size("priced") == F.size("parts") - 1) & (F.size(F.filter("priced", lambda c: c["amount"].isNotNull())) > 1)
    return written(read.withColumn("row", F.coalesce(F.when(row, cells(F.get("parts", 0)).isNull()), F.lit(False))), "fee-lines")


def _records(rows: DataFrame) -> DataFrame:
    """id, at, line, head, time, cells: each line that is not prices alone, with the prices on it and on the lines of prices below it."""
    page = Window.partitionBy("id").orderBy("at")
    head = F.when(F.col("tail").isNotNull(), F.regexp_replace(F.left("line", F.col("tail.at") - 1), r"^[ :\-–|\t]+|[ :\-–|\t]+$", "")).otherwise(F.col("line"))
    rows = rows.withColumns({"head": head, "inline": F.col("tail.cells")})
    rows = rows.withColumn("own", F.sum(F.when(F.col("cells").isNull(), 1).otherwise(0)).over(page))
    parts = F.array_sort(F.collect_list(F.struct("at", F.coalesce("cells", "inline").alias("cells"))))
    first = lambda c: F.min_by(c, "at").alias(c)
    records = rows.filter("own > 0").groupBy("id", "own").agg(F.min("at").alias("at"), first("line"), first("head"), first("inline"), parts.alias("parts"))
    every = F.flatten(F.filter(F.transform("parts", lambda p: p["cells"]), lambda c: c.isNotNull()))
    inline = F.col("inline").isNotNull()
    # a line with its own prices ends there
    return records.select("id", "at", "line", F.when(inline, F.col("head")).otherwise(F.col("line")).alias("head"), F.when(inline, F.col("inline")).otherwise(every).alias("cells"), inline.alias("inline")).withColumn("time", is_time(F.col("head")))


def _by_rows(records: DataFrame) -> DataFrame:
    """Tiers of grids whose rows are times: a header of categories, perhaps a group, then a time with a price for each category."""
    page = Window.partitionBy("id").orderBy("at")
    k = F.size("cells")
    row = F.col("time") & (F.size(F.filter("cells", lambda c: c["amount"].isNotNull())) >= F.when(F.col("inline"), 1).otherwise(2))
    r = records.withColumns({"row": row, "k": k})
    r = r.withColumn("before", F.sum(F.when(F.col("row"), 1).otherwise(0)).over(page) - F.when(F.col("row"), 1).otherwise(0))
    # labels since the last row stand before the next
    labels = F.array_sort(F.collect_list(F.when(~F.col("row"), F.struct("at", "line", F.col("time").alias("time"), (F.size("cells") > 0).alias("priced")))))
    runs = r.groupBy("id", "before").agg(labels.alias("labels"), *(F.max(F.when(F.col("row"), F.col(c))).alias(c) for c in ("at", "head", "k")), F.max_by("cells", F.when(F.col("row"), F.col("at"))).alias("cells")).filter("at IS NOT NULL")
    fits = lambda x: ~(x["line"].rlike(HEADING) | (F.length(x["line"]) > 60) | x["time"] | x["priced"])
    n = F.size("labels")
    last = F.get("labels", n - 1)
    grouped = (n > F.col("k")) & last["line"].rlike(GROUP) & F.forall(F.slice("labels", F.greatest(n - F.col("k"), F.lit(1)), F.col("k")), fits)
    plain = (n >= F.col("k")) & F.forall(F.slice("labels", F.greatest(n - F.col("k") + 1, F.lit(1)), F.col("k")), fits)
    text = lambda x: x["line"]
    header = F.when(grouped, F.transform(F.slice("labels", F.greatest(n - F.col("k"), F.lit(1)), F.col("k")), text)).when(plain, F.transform(F.slice("labels", F.greatest(n - F.col("k") + 1, F.lit(1)), F.col("k")), text))
    alone = (n > 0) & (F.length(last["line"]) <= 40) & ~last["line"].rlike(HEADING) & ~last["time"] & ~last["priced"]
    runs = runs.withColumns({"header": header, "group": F.when(grouped, last["line"]).when(~plain & alone, last["line"]), "wider": (F.lag("k").over(page) != F.col("k")).cast("int")})
    # rows of equal width share a header until the width changes
    runs = runs.withColumn("grid", F.sum(F.coalesce("wider", F.lit(1))).over(page))
    grid = Window.partitionBy("id", "grid").orderBy("at")
    runs = runs.withColumn("first_header", F.first("header", ignorenulls=True).over(grid)).withColumn("again", F.lag("first_header").over(grid).isNotNull())
    # a full set of labels within a grid is only a group's if it is one line
    group = F.last(F.when(~F.col("again") | (F.size("labels") == 1), F.when(F.col("again"), F.when(alone, last["line"])).otherwise(F.col("group"))), ignorenulls=True).over(grid)
    found = runs.withColumn("of_group", group).filter("first_header IS NOT NULL")
    cell = F.posexplode("cells").alias("col", "cell")
    each = found.select("id", "at", "head", "first_header", "of_group", cell)
    time = F.regexp_replace("head", r"^[ :\-–|]+|[ :\-–|]+$", "")
    return each.select("id", "at", "col", _label(F.col("of_group"), F.get("first_header", F.col("col")), time).alias("label"), "cell", time.rlike(EARLY).alias("early"), F.lit(None).cast("date").alias("deadline"))


def _by_columns(records: DataFrame) -> DataFrame:
    """Tiers of grids whose columns are times: two times at least above each other or side by side, then a label with a price for each."""
    page = Window.partitionBy("id").orderBy("at")
    title = F.col("time") & (F.size("cells") == 0)
    r = records.withColumn("title", title).withColumn("begins", (F.col("title") & ~F.coalesce(F.lag("title").over(page), F.lit(False))).cast("int"))
    r = r.withColumn("grid", F.sum("begins").over(page)).filter("grid > 0")
    grid = Window.partitionBy("id", "grid").orderBy("at")
    whole = Window.partitionBy("id", "grid")
    header = F.transform(F.array_sort(F.collect_list(F.when(F.col("title"), F.struct("at", "head"))).over(whole)), lambda x: F.regexp_replace(x["head"], r"^[ :\-–|]+|[ :\-–|]+$", ""))
    r = r.withColumn("header", header).filter("size(header) > 1 AND NOT title")
    fits = (F.size("cells") == F.size("header")) & (F.col("inline") | ~F.col("line").rlike(HEADING)) & (F.length("head") <= 80)
    group = (F.size("cells") == 0) & (F.length("line") <= 40) & F.col("line").rlike(GROUP)
    r = r.withColumns({"fits": fits, "group": group}).withColumn("stops", F.sum(F.when(F.col("fits") | F.col("group"), 0).otherwise(1)).over(grid))
    r = r.filter("stops = 0").withColumn("of_group", F.last(F.when(F.col("group"), F.col("line")), ignorenulls=True).over(grid))
    each = r.filter("fits").select("id", "at", "head", "header", "of_group", F.posexplode("cells").alias("col", "cell"))
    time = F.get("header", F.col("col"))
    return each.select("id", "at", "col", _label(F.col("of_group"), F.col("head"), time).alias("label"), "cell", time.rlike(EARLY).alias("early"), F.lit(None).cast("date").alias("deadline"))


def _by_tabs(rows: DataFrame) -> DataFrame:
    """Tiers of tabbed grids: a label and a price for each time, whose names, and days after them, stand on the lines above."""
    t = rows.select("id", "at", "parts", F.col("priced").alias("cells"), "row")
    label = F.get("parts", 0)
    first = t.filter("row").groupBy("id").agg(F.min("at").alias("first"))
    t = t.join(first, "id")
    above = t.filter((F.col("at") < F.col("first")) & (F.col("at") >= F.col("first") - ABOVE)).groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "parts"))), lambda x: x["parts"])).alias("said"))
    # the header begins at the cell that names the labels, if there is one
    begins = F.array_max(F.filter(F.transform("said", lambda x, i: F.when(x.rlike(TAB_HEAD), i)), lambda i: i.isNotNull()))
    kept = F.filter(F.slice("said", F.coalesce(begins, F.lit(0)) + 1, F.size("said")), lambda x: ~x.rlike(TAB_SKIP))
    names = F.filter(F.transform(kept, lambda x, i: F.struct(x.alias("name"), F.get(kept, i + 1).alias("next"))), lambda x: ~x["name"].rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.length(x["name"]) <= 30) & x["name"].rlike("[A-Za-z]{3}"))
    each = t.filter("row").join(above.select("id", names.alias("names")), "id").filter(F.size("names") >= F.size("cells"))
    each = each.select("id", "at", label.alias("head"), F.slice("names", F.size("names") - F.size("cells") + 1, F.size("cells")).alias("names"), F.posexplode("cells").alias("col", "cell"))
    time = F.get("names", F.col("col"))
    early = time["name"].rlike(EARLY)
    return each.select("id", "at", "col", _label(F.col("head"), time["name"]).alias("label"), "cell", early.alias("early"), F.when(early, texts.safe_date(time["next"])).alias("deadline"))


def tiers(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, place, label, price, currency, early, deadline: the tiers of a text's fee grid.

    Grids by rows are taken first, then by columns, then tabbed ones, the first sort that gives 4 tiers at least. Labels
    are group, category and time; equal labels with equal prices are one tier. A cell without a currency that is known,
    without a price, or with an implausible one gives none. Null and empty texts, and texts without a grid, have no
    tiers. Nothing is cut off after so many lines or tiers.
    """
    rows = _read(lines(pages, id_col, text_col))
    records = _records(rows.repartition("id"))
    sorts = [_by_rows(records), _by_columns(records), _by_tabs(rows)]
    each = None
    for order, found in enumerate(sorts):
        found = found.withColumn("sort", F.lit(order))
        each = found if each is None else each.unionByName(found)
    price, code = F.col("cell.amount"), F.col("cell.currency")
    each = each.filter((price > 0) & money.plausible(price, code)).select("id", "sort", "at", "col", "label", price.alias("price"), code.alias("currency"), "early", "deadline")
    first = F.row_number().over(Window.partitionBy("id", "sort", F.lower("label"), "price").orderBy("at", "col"))
    unique = each.withColumn("again", first).filter("again = 1").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id", "sort"))).filter(F.col("n") >= LEAST)
    best = unique.withColumn("best", F.min("sort").over(Window.partitionBy("id"))).filter("sort = best")
    return best.select(F.col("id").alias(id_col), F.struct("at", "col").alias("place"), "label", "price", "currency", "early", "deadline")
