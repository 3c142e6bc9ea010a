"""Main text of web pages: a style tree for each site finds the branches that carry little, which are cut from its pages."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import materialize, tidy
from eventide.llm.url_rules import host_of

#: Elements that never belong to an article.
ASIDE_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select textarea svg math head title dialog menu object embed audio video canvas".split())
#: Words of class and id attributes, and roles, that name such elements.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus reply replies respond widget toolbar pagination pager login search copyright legal disclaimer contentinfo complementary form dialog".split()
)
#: Those of them that name what readers wrote, which may well be longer than the article.
REMARKS = frozenset("comment comments disqus reply replies respond".split())
#: Words before them that only say how a page is laid out: no-sidebar, has-comments.
STATES = frozenset("no not non has have with without hide hidden is".split())
MAIN_TAGS = frozenset(["article", "main"])
#: Elements that names never make an aside.
WHOLE = MAIN_TAGS | {"html", "body"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A new element of the first kind ends an open one of the second.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ONLY = frozenset(["p"])
SCOPE = frozenset("ul ol dl table article section div main body".split())

#: A tag, by HTML's rules for attributes: values in quotes, or up to white space or ">"; a quote that nothing closes is a letter.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)?)*+)>")
NAMED = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))", re.I)
ENDS = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """What a page holds.

    nodes: of each style node (0: the page) its parent, label and hash; a node is known by the labels from the root to
    it, which its hash takes in one by one. children: node -> labels of its elements. blocks: of each block of text, in
    page order, its node, the text, and whether it is in an aside and in an article.
    """

    def __init__(self):
        self.parent, self.label, self.hash = [-1], [""], [0]
        self.known: dict[tuple[int, str], int] = {}
        self.children: dict[int, list[str]] = {}
        self.blocks: list[tuple[int, str, bool, bool]] = []

    def below(self, node: int, label: str) -> int:
        self.children.setdefault(node, []).append(label)
        k = self.known.setdefault((node, label), len(self.label))
        if k == len(self.label):
            self.parent.append(node)
            self.label.append(label)
            self.hash.append(_short(f"{self.hash[node]}/{label}"))
        return k


class Part:
    """Text that stands together: its node, whether in an aside and in an article, and the innermost element named as an aside (-1: none)."""

    __slots__ = ("aside", "main", "named", "node", "parts")

    def __init__(self, node: int, aside: bool, main: bool, named: int):
        self.node, self.aside, self.main, self.named, self.parts = node, aside, main, named, []


def _aside_name(names: str) -> str:
    """What kind of aside the names tell: "remarks", "aside", "part" (an aside's word among others) or "" (none)."""
    kind = ""
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not ASIDE_WORDS.isdisjoint(words) and STATES.isdisjoint(words):
            if not REMARKS.isdisjoint(words):
                return "remarks"
            kind = "aside" if kind == "aside" or ASIDE_WORDS.issuperset(words) else "part"
    return kind


def _dropped(found: list[tuple[int, str, bool, bool, int]], kinds: list[str], up: list[int], whole: list[bool]) -> list[bool]:
    """Which of the elements named as asides are asides, or in one: not what holds most of the text of the page's articles (of
    the page, without one), unless readers wrote it; not what holds an article, if its name says more than that it is an
    aside (a sidebar has teasers, which may be articles too); and none that leaves no text. up: the named element around each."""
    own = [b for b in found if not b[2]]
    if any(b[3] for b in own):
        own = [b for b in own if b[3]]
    size = [0] * len(kinds)
    for _, said, _, _, named in own:
        if named >= 0:
            size[named] += len(said)
    for k in range(len(kinds) - 1, -1, -1):
        if up[k] >= 0:
            size[up[k]] += size[k]
            whole[up[k]] |= whole[k]
    total = sum(len(b[1]) for b in own)
    gone = [size[k] < total and (kind == "remarks" or 2 * size[k] <= total and not (kind == "part" and whole[k])) for k, kind in enumerate(kinds)]
    for k, over in enumerate(up):
        gone[k] |= over >= 0 and gone[over]
    return gone if any(b[4] < 0 or not gone[b[4]] for b in own) else [False] * len(kinds)


def parse(page: str | None) -> Page:
    """A page's style nodes and blocks of text, in one pass whose time is in proportion to the page's length, however it nests.

    A style node is a block element with the names in its class, id and role. An aside is known by its element or by its
    name, see _dropped(). Markup that the end of the page cuts off is no text; nor is a comment that nothing closes.
    """
    page, out = page or "", Page()
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]  # tag, node, in an aside, in an article, element named as an aside
    scopes: list[Counter] = [Counter()]  # tags that are open in each open element of SCOPE
    opened: Counter = Counter()
    kinds: list[str] = []
    up: list[int] = []
    whole: list[bool] = []
    done: list[Part] = []
    now = Part(0, False, False, -1)

    def fresh():
        nonlocal now
        if now.parts:
            done.append(now)
        now = Part(*stack[-1][1:])

    def text(s: str):
        if s:
            if stack[-1][2:] != (now.aside, now.main, now.named):
                fresh()
            now.parts.append(s)

    def close(k: int):
        apart = False
        while len(stack) > k:
            tag = stack.pop()[0]
            apart |= tag not in INLINE
            opened[tag] -= 1
            if tag in SCOPE:
                scopes.pop()
            scopes[-1][tag] -= 1
        if apart:
            fresh()

    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0 or mark == n - 1:
            text(page[at:])
            break
        text(page[at:mark])
        ahead = page[mark + 1]
        if ahead in "!?":
            comment = page.startswith("<!--", mark)
            end = page.find("-->", mark + 2) if comment else page.find(">", mark)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        if not (ahead.isascii() and ahead.isalpha() or ahead == "/" and page[mark + 2 : mark + 3].isascii() and page[mark + 2 : mark + 3].isalpha()):
            text("<")
            at = mark + 1
            continue
        m = TAG.match(page, mark)
        if not m:
            break  # no tag ends from here on
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in ENDS_P or tag in SELF_CLOSING:
            ends = P_ONLY if tag in ENDS_P else SELF_CLOSING[tag]
            if any(scopes[-1][t] > 0 for t in ends):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ends))
        named = NAMED.findall(m[3]) if m[3] else ()
        names = " ".join(a or b or c for _, a, b, c in named)
        _, node, aside, main, under = stack[-1]
        if tag not in INLINE:
            node = out.below(node, tag + "".join(sorted("." + w for w in {re.sub(r"\d+", "", x) for x in names.split()} if w)))
        aside = aside or tag in ASIDE_TAGS
        article = tag in MAIN_TAGS or any(k.lower() == "role" and "main" in (a or b or c) for k, a, b, c in named)
        if article and not aside:
            if under >= 0:
                whole[under] = True
        elif names and tag not in WHOLE and (kind := _aside_name(names)):
            kinds.append(kind), up.append(under), whole.append(False)
            under = len(kinds) - 1
        main = main or article
        if tag in VOID or m[3].endswith("/") and tag in INLINE:
            if tag not in INLINE:
                fresh()
            continue
        stack.append((tag, node, aside, main, under))
        opened[tag] += 1
        scopes[-1][tag] += 1
        if tag in SCOPE:
            scopes.append(Counter())
        if tag not in INLINE:
            fresh()
        if tag in RAW:
            end = ENDS[tag].search(page, at)
            stop = end.start() if end else n
            text(page[at:stop])
            at = stop
    fresh()
    found = []
    for b in done:
        said = " ".join(html.unescape("".join(b.parts)).split())
        if said:
            found.append((b.node, said, b.aside, b.main, b.named))
    gone = _dropped(found, kinds, up, whole) if kinds else []
    out.blocks = [(node, said, aside or k >= 0 and gone[k], main) for node, said, aside, main, k in found]
    return out


def _short(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, node (hash of a style node), pages, importance, variants: every site's style tree, its pages merged.

    Pages of a site with the same body are one page, however often and under whatever urls it stands: each of its
    copies counts as a share of one.

    A node's content importance is 1 less the mean entropy of its blocks over the site's pages, by base m of the m
    pages that have it: 0 if every page says the same there, 1 if none repeats another. Its presentation importance
    is the entropy of its sequence of children over those pages. A node has the larger of the two; a node of one page has 1.
    A branch has the importance of its most important node, so that it goes only if all of it is low.
    ``variants`` is the number of equally frequent texts that have a node's entropy (pages ** importance), for a branch its most.
    Counts are summed within batches and by Spark before each shuffle, so that a site of very many pages is no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: Counter = Counter()
            logs: Counter = Counter()
            for host, page, share in zip(*(c.to_pylist() for c in b.columns), strict=True):
                had = parse(page)
                said = Counter((node, text) for node, text, _, _ in had.blocks)
                for (node, text), c in said.items():
                    key = (host, had.hash[node], "text", _short(text))
                    sums[key] += c * share
                    logs[key] += c * math.log(c) * share
                for node, children in had.children.items():
                    sums[host, had.hash[node], "style", _short(" ".join(dict.fromkeys(children)))] += share
                for node in {n for n, _ in said} | had.children.keys():
                    sums[host, had.hash[node], "page", 0] += share
                for node, over in enumerate(had.parent[1:], 1):
                    sums[host, had.hash[node], "parent", had.hash[over]] += share
            keys = list(zip(*sums, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.string()), pa.array(keys[3], pa.int64()), pa.array([float(n) for n in sums.values()], pa.float64()), pa.array([float(logs[k]) for k in sums], pa.float64())],
                names=["host", "node", "kind", "feature", "n", "clogc"],
            )

    html = F.col(html_col)
    work = pages.select(host_of(url_col).alias("host"), html.alias("html"), F.xxhash64(F.substr(html, F.greatest(F.locate("<body", F.lower(html)), F.lit(1)))).alias("body"))
    copies = materialize(work.groupBy("host", "body").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "page-copies")
    few = copies.count() <= BROADCAST_COPIES
    work = work.join(F.broadcast(copies) if few else copies, ["host", "body"], "left").select("host", "html", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("share"))
    rows = work.mapInArrow(tidy(run), "host string, node long, kind string, feature long, n double, clogc double")
    each = materialize(rows.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("clogc").alias("clogc")), "style-features")
    text, style, page = (F.col("kind") == k for k in ("text", "style", "page"))
    node = each.filter("kind <> 'parent'").groupBy("host", "node").agg(
        F.round(F.max(F.when(page, F.col("n")))).cast("long").alias("pages"),
        F.avg(F.when(text, F.log("n") - F.col("clogc") / F.col("n"))).alias("repeats"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("style_nlogn"),
        F.sum(F.when(style, F.col("n"))).alias("style_n"),
    )
    base = F.log("pages")
    content = 1 - F.col("repeats") / base
    presentation = (F.log("style_n") - F.col("style_nlogn") / F.col("style_n")) / base
    own = node.select("host", "node", "pages", F.when(F.col("pages") <= 1, F.lit(1.0)).otherwise(F.greatest(F.coalesce(content, F.lit(0.0)), F.coalesce(presentation, F.lit(0.0)))).alias("importance"))
    own = own.withColumn("variants", F.pow("pages", "importance"))
    over = each.filter("kind = 'parent'").select("host", "node", F.col("feature").alias("over"))
    return _branches(own.join(over, ["host", "node"], "full_outer").na.fill(0.0, ["importance", "variants"]))


def _branches(nodes: DataFrame) -> DataFrame:
    """host, node, pages, importance, variants, the last two the largest of a node and all below it.

    Each round doubles how far below a node its numbers look, and how far above (over) it hands its own; so there are as
    many rounds as the logarithm of a site's depth.
    """
    nodes = materialize(nodes.select("host", "node", "over", "pages", "importance", "variants"), "style-nodes")
    while not (hand := nodes.filter("over is not null")).isEmpty():
        given = hand.groupBy("host", F.col("over").alias("node")).agg(F.max("importance").alias("below"), F.max("variants").alias("most"))
        further = hand.select("host", F.col("node").alias("over"), F.col("over").alias("next"))
        nodes = nodes.join(given, ["host", "node"], "left").join(further, ["host", "over"], "left")
        best = lambda own, more: F.greatest(own, F.coalesce(more, F.lit(0.0))).alias(own)
        nodes = materialize(nodes.select("host", "node", F.col("next").alias("over"), "pages", best("importance", "below"), best("variants", "most")), "style-nodes")
    return nodes.drop("over")


def main_text(page: str | None, cut: set[int]) -> str:
    """The article of one page, without the style nodes in ``cut`` and what stands below them.

    An article element and what it stands in are never cut, nor is anything if nothing would be left.
    """
    had = parse(page)
    found = [b for b in had.blocks if not b[2]]
    if any(b[3] for b in found):
        found = [b for b in found if b[3]]
    if not cut:
        return " ".join(b[1] for b in found)
    # of each node, parents first: is it in an article element, is it kept as one outside, and as one in an article
    inside, plain, kept = [False], [True], [True]
    for over, label, name in zip(had.parent[1:], had.label[1:], had.hash[1:], strict=True):
        low = name in cut
        inside.append(inside[over] or label.split(".")[0] in MAIN_TAGS or "main" in label.partition(".")[2])
        plain.append(plain[over] and not low)
        # what has no name of its own in an article is the article's text, on however many pages it repeats
        kept.append(kept[over] and not (low and "." in label) if inside[over] or not inside[-1] else True)
    return " ".join(b[1] for b in [b for b in found if (kept if b[3] else plain)[b[0]]] or found)


#: A node below this importance on at least so many pages is cut, unless it has so many variants: a few articles on very many pages.
LEAST_IMPORTANCE, LEAST_PAGES, LEAST_VARIANTS = 0.2, 5, 2
#: Bodies that stand on several pages are broadcast up to so many; beyond, they are joined to their site's pages.
BROADCAST_COPIES = 100_000
#: Cut nodes are broadcast up to so many; beyond, they are joined to their site's pages.
BROADCAST_NODES = 100_000


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """id, url, text, n_chars of every page: its article, in whole.

    Character references are decoded, white space in a block is one space, and blocks are joined by one space in page
    order. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are known by their
    elements and names, and by the site's style tree: branches of low importance go. A page without an article
    keeps what is left of its body. A null or empty page has an empty text; a null url is the site "".
    Repeated rows give a row each; other columns are left out; an empty table gives an empty one.
    """
    low = style_tree(pages, url_col, html_col).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE) & (F.col("variants") < LEAST_VARIANTS)).select("host", "node")
    low = low.groupBy("host").agg(F.collect_list("node").alias("cut"))  # bounded by the nodes of a site's style tree
    work = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    low = materialize(low, "cut-nodes")
    few = low.agg(F.sum(F.size("cut")).alias("n")).first()["n"] or 0
    if few <= BROADCAST_NODES:
        work = work.join(F.broadcast(low), "host", "left")
    else:
        salts = 64
        work = work.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(salts)))
        work = work.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, set(c or ())) for h, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return work.select("page_id", "url", "html", "cut").mapInArrow(tidy(run), f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
