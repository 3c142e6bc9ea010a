"""References resolved against their page's address, and the site that an address belongs to. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that stand before a country's, so that a site's name has one label more.
SECOND = ["co", "com", "org", "ac", "gov", "net", "nhs", "edu"]
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME, HOST, PATH, QUERY, FRAGMENT = range(1, 6)


def part(url: Column, which: int) -> Column:
    """One of an address's five parts, without its mark but for query and fragment; empty if it has none."""
    return F.regexp_extract(url, PARTS, which)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments; .. above the top is dropped."""

    def walk(kept: Column, s: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.when(s == ".", kept).when(s == "..", up).otherwise(F.concat(kept, F.array(s)))

    def joined(x: Column) -> Column:
        done = F.array_join(F.aggregate(x["segments"], F.array().cast("array<string>"), walk), "/")
        open_end = F.element_at(x["segments"], -1).isin(".", "..")
        return F.transform(F.array(done), lambda d: F.concat(F.when(x["path"].startswith("/") & ~d.startswith("/"), "/").otherwise(""), d, F.when(open_end & ~d.endswith("/") & (d != ""), "/").otherwise("")))[0]

    return F.when(path.contains("."), F.transform(F.array(F.struct(F.split(path, "/", -1).alias("segments"), path.alias("path"))), joined)[0]).otherwise(path)


def resolved(ref: Column, base: Column) -> Column:
    """The address that a reference on a page stands for, as RFC 3986 has it; null without a reference or without a base to resolve it by."""
    of = lambda url: F.struct(*(part(url, i).alias(name) for name, i in (("scheme", SCHEME), ("host", HOST), ("path", PATH), ("query", QUERY), ("fragment", FRAGMENT))))

    def join(x: Column) -> Column:
        r, b = x["ref"], x["base"]
        tail = F.concat(r["query"], r["fragment"])
        origin = F.concat(b["scheme"], F.lit("://"), b["host"])
        folder = F.regexp_replace(b["path"], "[^/]*$", "")
        path = F.when(x["hosted"] | r["path"].startswith("/"), r["path"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), r["path"]))
        here = F.concat(origin, b["path"], F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"])
        own = F.concat(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]), F.lit("://"), r["host"])
        return F.when(~x["hosted"] & (r["scheme"] != ""), x["said"]).when(~x["hosted"] & (r["path"] == ""), here).otherwise(F.concat(F.when(x["hosted"], own).otherwise(origin), without_dots(path), tail))

    # the parts are read once, however often they are used
    read = F.struct(of(ref).alias("ref"), of(base).alias("base"), ref.alias("said"), ref.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//").alias("hosted"))
    return F.when(base.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") & ref.isNotNull(), F.transform(F.array(read), join)[0])


def host(url: Column) -> Column:
    """The host in small letters, without a user, port or leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(part(url, HOST), r"^(?:[^@]*@)?([^:]*)", 1)), r"^www\.", "")


def site(url: Column) -> Column:
    """The part of a host that is registered: its last two labels, three where the second from the end is a general one before a country's."""
    labels = F.split(host(url), r"\.")
    three = (F.size(labels) > 2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, F.size(labels) - 2).isin(*SECOND)
    n = F.when(three, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def outside(url: Column, base: Column) -> Column:
    """True for an address on a page's own host that lies outside the page's section; pages less than three levels deep have none."""
    levels = F.filter(F.split(part(base, PATH), "/"), lambda s: s != "")
    above = F.concat(F.lit("/"), F.array_join(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), "/"), F.lit("/"))
    own = F.concat(F.regexp_replace(part(url, PATH), "/+$", ""), F.lit("/"))
    return (F.lower(part(url, HOST)) == F.lower(part(base, HOST))) & (F.size(levels) >= 3) & ~own.startswith(above)
