"""Operator 13: URL filters as a sort-merge range join of urls with nested host and path rules.

A host's canonical key is its labels in reverse order, each closed by a dot (``net.example.``), so that a host and all its
subdomains are the keys with one prefix, one interval of the sorted keys.  Urls and rules are cut into
ranges of (key, path, draw) whose borders come from a sample, which decides balance and never the result; a rule goes to every range
that its interval meets, so a range is complete in itself.  A range is swept in key order with a stack of active hosts: hosts
whose interval has ended are popped, so the stack holds exactly the rules nested around the current url, inner ones on top.
In each of them the path rules are sorted and every one links to the longest rule that it extends, so the longest one that
starts the url's path is found by one binary search.  Borders may lie inside one host, or inside one repeated url (``draw``
is a number of its own for every row), so a host with a third of all urls is split; a range holds the rules of the hosts it meets.

Longest means host and path characters together; of equally long rules the one with the longer host wins, of rules
with the same host and path ``block``.  A url without a fitting rule gets ``default``.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the default verdict; a path is compared as it
is, so a url without any path meets no rule; hosts keep ports and user parts; null and repeated ids get a row each; extra
columns of the input are left out by ``judged`` and kept by ``allowed``, also where they are named like a result; very long urls
are compared whole; rules with a null part are left out, an empty rule table lets ``default`` decide; no urls, no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVENT = "part int, key string, kind int, path string, draw long, page_id long, host string, verdict string"


@dataclass(frozen=True)
class FilterConfig:
    default: str = "allow"
    sample_per_range: int = 40       # urls sampled for each range's border
    ranges: int | None = None        # spark.sql.shuffle.partitions where unset


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path, both empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")       # a null url has no position either
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot; the empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class HostRules:
    """Path rules of one host: sorted, each linked to the longest other rule that starts it."""

    __slots__ = ("host", "key", "outer", "paths", "verdicts")

    def __init__(self, key: str, host: str, rules: dict[str, str]):
        self.key, self.host = key, host
        self.paths = sorted(rules)
        self.verdicts = [rules[p] for p in self.paths]
        self.outer, active = [], []
        for i, path in enumerate(self.paths):
            while active and not path.startswith(self.paths[active[-1]]):
                active.pop()
            self.outer.append(active[-1] if active else -1)
            active.append(i)

    def longest(self, path: str) -> int:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


def sweep(rows: Iterator[tuple], default: str) -> Iterator[tuple]:
    """(page_id, host, path, rule, verdict) of the urls of sorted (part, key, kind, path, draw, page_id, host, verdict)."""
    stack: list[HostRules] = []
    part, opening = None, None                    # rules of the host that is being read
    for now, key, kind, path, _, page_id, host, verdict in rows:
        if now != part:
            stack, part, opening = [], now, None
        if opening is not None and (kind == 1 or key != opening[0]):
            stack.append(HostRules(*opening))
            opening = None
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if kind == 0:
            if opening is None:
                opening = (key, host, {})
            if opening[2].get(path) != "block":
                opening[2][path] = verdict
            continue
        best = None
        for held in reversed(stack):              # inner hosts first, so equal lengths keep the longer host
            at = held.longest(path)
            if at >= 0 and (best is None or len(held.host) + len(held.paths[at]) > best[0]):
                best = (len(held.host) + len(held.paths[at]), held.host + held.paths[at], held.verdicts[at])
        yield page_id, host, path, best[1] if best else None, best[2] if best else default


def _borders(urls: DataFrame, ranges: int, per_range: int) -> list[tuple]:
    """Sorted borders between ranges from a sample of fixed size; long keys are cut, as a border need not be a url."""
    if ranges < 2:
        return []
    rows = urls.select(F.substring("key", 1, 256).alias("key"), F.substring("path", 1, 256).alias("path"), "draw")
    found = sorted(tuple(r) for r in rows.orderBy(F.xxhash64("draw")).limit(ranges * per_range).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _dealt(events: DataFrame, borders: list[tuple]) -> DataFrame:
    """Every event with its range; a rule once for each range that its host's interval meets."""
    def run(batches):
        for batch in batches:
            at, part = [], []
            for i, (key, kind, path, draw) in enumerate(zip(*(batch[c].to_pylist() for c in ("key", "kind", "path", "draw")))):
                low = bisect_right(borders, (key, path, draw) if kind else (key,))
                high = low
                while not kind and high < len(borders) and borders[high][0].startswith(key):
                    high += 1
                at += [i] * (high - low + 1)
                part += range(low, high + 1)
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *out.columns], ["part", *batch.schema.names])

    return events.select("key", "kind", "path", "draw", "page_id", "host", "verdict").mapInArrow(run, EVENT)


def judged(pages: DataFrame, rules: DataFrame, cfg: FilterConfig = FilterConfig(), page_id: str = "page_id",
           url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``; ``rules`` has host, path and verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = Workspace(spark, "urls").table(urls.withColumn("key", host_key(F.col("host")))
                                          .withColumn("draw", F.xxhash64("path", F.monotonically_increasing_id())), "urls")
    held = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select(
        F.translate(F.col("host"), UPPER, LOWER).alias("host"), "path", "verdict").where("host <> ''").distinct()
    ranges = cfg.ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(urls, ranges, cfg.sample_per_range)
    events = urls.select("key", F.lit(1).alias("kind"), "path", "draw", "page_id", "host", F.lit(None).cast("string").alias("verdict")).union(
        held.select(host_key(F.col("host")), F.lit(0), "path", F.lit(0).cast("long"), F.lit(None).cast("long"), "host", "verdict"))
    dealt = (_dealt(events, borders).repartition(ranges, "part")
             .sortWithinPartitions("part", "key", "kind", "path", "draw"))

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for row in sweep(rows, cfg.default):
            out.append(row)
            if len(out) == 8192:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    page_id, *rest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(page_id, pa.int64()), *(pa.array(c, pa.string()) for c in rest)],
                                      ["page_id", "host", "path", "rule", "verdict"])


def allowed(pages: DataFrame, rules: DataFrame, cfg: FilterConfig = FilterConfig(), url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose url is not blocked, all columns as they are."""
    one = pages.select(F.col(url).alias("url")).distinct().withColumn("page_id", F.lit(0))
    blocked = judged(one, rules, cfg).where("verdict = 'block'").select("host", "path").distinct()
    host, path = host_and_path(F.col(url))
    return pages.join(blocked, (host == blocked["host"]) & (path == blocked["path"]), "left_anti")
