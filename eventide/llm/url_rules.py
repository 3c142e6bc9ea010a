"""URL allow and block rules as intervals over reversed hosts, joined by a sorted sweep with a stack."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import materialize

#: Rules are broadcast in portions of at most this many bytes; each further portion is a further sweep, without a shuffle.
PORTION_BYTES = 8_000_000


def _rest(url: str) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))


def host_of(url: str) -> Column:
    host = F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: str) -> str:
    """``blog.example.net`` -> ``net.example.blog.``: a host and its subdomains are the keys with one prefix."""
    return ".".join(reversed(host.split("."))) + "."


def sweep(keys: list[str], starts: list[str]) -> Iterator[tuple[str, list[int]]]:
    """For each key, in order, the places in ``starts`` of its prefixes. Both are sorted; open intervals are kept on a stack."""
    stack: list[int] = []
    nxt = 0
    for key in keys:
        while stack and not key.startswith(starts[stack[-1]]):
            stack.pop()
        while nxt < len(starts) and starts[nxt] <= key:
            if key.startswith(starts[nxt]):  # else the interval has ended before this key
                stack.append(nxt)
            nxt += 1
        yield key, stack


def _judge(rules: list[tuple[str, str, str]]):
    """A function of host and path lists -> the best rule of each, or None. rules: host, path, verdict."""
    by_key: dict[str, list[tuple[str, str, str]]] = {}
    for host, path, verdict in rules:
        by_key.setdefault(reversed_host(host), []).append((path, host + path, verdict))
    starts = sorted(by_key)
    lists = [sorted(by_key[k], key=lambda r: (-len(r[0]), r[0], r[2] != "block")) for k in starts]

    def work(hosts: list[str], paths: list[str]) -> list[tuple[str, int, str] | None]:
        rows: dict[str, list[int]] = {}
        for k, h in enumerate(hosts):
            rows.setdefault(h, []).append(k)
        keyed = sorted((reversed_host(h), h) for h in rows if h)
        best: list[tuple[str, int, str] | None] = [None] * len(hosts)
        for (_, stack), (_, host) in zip(sweep([k for k, _ in keyed], starts), keyed, strict=True):
            for k in rows[host] if stack else ():
                for place in reversed(stack):  # from the longest host
                    for path, rule, verdict in lists[place]:
                        if paths[k].startswith(path):
                            if best[k] is None or len(rule) > best[k][1]:
                                best[k] = (rule, len(rule), verdict)
                            break
        return best

    return work


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of every page.

    rules: host, path, verdict (``allow`` or ``block``). A rule fits its host and the subdomains, if the url's path
    starts with the rule's. The longest host and path together wins, then the longest host, then ``block``.
    A host's rules are one interval of reversed-host keys; every batch sorts its keys and sweeps them against the
    sorted intervals, so no url leaves its partition and a host with many pages is no hot key. Rules come in portions
    of bounded size; the best of all portions is kept, so their number is not limited.
    A null url or one without ``://`` has an empty host and path, no rule and the default verdict. Rules with a null
    host, path or verdict, or an empty host, fit nothing. Repeated rows and ids give a row each; other columns are
    left out; an empty table or rule set is allowed.
    """
    usable = rules.select("host", "path", "verdict").dropna().filter("host <> ''").withColumn("host", F.lower("host")).distinct()
    size = usable.agg(F.sum(F.length("host") + F.length("path") + 8).alias("n")).first()["n"] or 0
    portions = size // PORTION_BYTES + 1
    out = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    for k in range(portions):
        part = usable if portions == 1 else usable.filter(F.pmod(F.xxhash64("host"), F.lit(portions)) == k)
        shared = pages.sparkSession.sparkContext.broadcast([(r["host"], r["path"], r["verdict"]) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            work = _judge(shared.value)
            for b in batches:
                rule, verdict = b.column(3).to_pylist(), b.column(4).to_pylist()
                for i, best in enumerate(work(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    if best and (rule[i] is None or best[1] > len(rule[i])):
                        rule[i], verdict[i] = best[0], best[2]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

        out = out.mapInArrow(run, out.schema)
        if portions > 1:  # one portion's rules at a time
            out = materialize(out, "url-rules")
            shared.unpersist()
    return out.withColumnRenamed("id", id_col)
