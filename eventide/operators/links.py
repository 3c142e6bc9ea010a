"""Links of pages: found, resolved, and ranked by what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import urls

# What links to registration and fees say, in several languages, and links that are never meant.
REGISTRATION = (
    r"(?i)\b(?:registration|register|fees?|pricing|prices?|rates?|tickets?|book(?:ing)?|costs?|attend(?:ing)?|delegate\s+(?:information|info|rates?|fees?)|how\s+to\s+(?:book|register)|"
    r"inscripci[oó]n|inscription|anmeldung|registrierung|tarifs?|kosten|geb[uü]hren|iscrizione|quote|preise|inschrijving|tarieven)\b"
)
NEVER = r"(?i)newsletter|subscribe|unsubscribe|log\s?in|sign\s?in|privacy|cookie"
NO_PAGE = r"(?i)^(?:#|javascript:|mailto:|tel:|data:)"
# End of fixed values.

ANCHOR = r"(?is)<a\b([^>]*)>(.*?)(?=</a\b|<a\b|\z)"
REFERENCES = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _plain(x: Column) -> Column:
    for name, sign in REFERENCES.items():
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, place, href, text, url, same_site: every link of a page, in its order, resolved against the page's address or its <base>.

    Links without an href, to a place on the page, and to what is no page are left out; so are those in comments and
    scripts. A null html has no links; a page without an address keeps its links' own ones, the others have a null url.
    """
    html = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    attribute = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, rf"""(?is)(?:^|\s)href\s*=\s*{q}""", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")))
    found = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(F.trim(_plain(attribute(F.regexp_extract(a, ANCHOR, 1)))).alias("href"), F.trim(_plain(F.regexp_replace(F.regexp_replace(F.regexp_extract(a, ANCHOR, 2), "<[^>]*>", " "), r"\s+", " "))).alias("text")))
    stated = attribute(F.regexp_extract(html, r"(?is)<base\b([^>]*)>", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("page"), F.coalesce(urls.resolved(stated, F.col(url_col)), F.col(url_col)).alias("base"), F.posexplode(found).alias("place", "link"))
    rows = rows.filter(F.col("link.href").isNotNull() & (F.col("link.href") != "") & ~F.col("link.href").rlike(NO_PAGE))
    href = F.col("link.href")
    url = F.coalesce(urls.resolved(href, F.col("base")), F.when(href.rlike("(?i)^https?://"), href))
    return rows.select(F.col("id").alias(id_col), "place", "page", href.alias("href"), F.col("link.text").alias("text"), url.alias("url")).withColumn("same_site", urls.site(F.col("url")) == urls.site(F.col("page")))


def ranked(links: DataFrame, wanted: list[str], k: int = 3, never: str = NEVER, id_col: str = "page_id") -> DataFrame:
    """id, rank, url, text: of each page's links to its own host the k best: those whose text or path says the first of the wanted patterns before the second, the page's order among equals.

    An address counts once, without its fragment; the page itself and links that are never meant are left out.
    """
    clean = F.regexp_replace("url", "#.*$", "")
    path = F.translate(urls.part(F.col("url"), urls.PATH), "-_", "  ")
    said = [F.left("text", F.lit(80)).rlike(w) | path.rlike(w) for w in wanted]
    bucket = F.coalesce(*(F.when(s, i) for i, s in enumerate(said)))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", "")
    own = links.filter((urls.host(F.col("url")) == urls.host(F.col("page"))) & F.col("url").rlike("(?i)^https?://") & (trimmed("url") != trimmed("page")))
    fits = own.filter(~F.col("text").rlike(never) & ~urls.part(F.col("url"), urls.PATH).rlike(never)).select(id_col, "place", clean.alias("url"), "text", bucket.alias("bucket")).filter("bucket IS NOT NULL")
    first = fits.groupBy(id_col, "url").agg(F.min(F.struct("bucket", "place", "text")).alias("best")).select(id_col, "url", "best.*")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("bucket", "place"))
    return first.withColumn("rank", order).filter(F.col("rank") <= k).select(id_col, "rank", "url", F.left("text", F.lit(60)).alias("text"))
