"""URL filters as a sort-merge range join.

A host is written from its last label to its first, each label followed by a
space, so a rule's host is a prefix of the keys of its subdomains: an interval
of the sorted keys.  Urls are range-partitioned by key (ties by id, so a hot
host is cut too) and written; each partition is swept in order beside the rules
whose intervals meet it.  The sweep keeps a stack of active nested hosts; the
rules of a host are nested path prefixes.  The longest fitting rule (host and
path together, then the longer host) decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import lower_ascii, store

RULE_SCHEMA = "host string, path string, verdict string"
#: Rows of a partition of the sweep, about.
PART_ROWS = 100_000
MAX_PARTS = 20_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com example www `` (a host holds no blank that matters)."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\t"), F.lit("\t"))
    )


def sweep(urls: list[tuple[str, str]], rules: list[tuple[str, str, str, str]]) -> list[tuple[str, str] | None]:
    """``urls`` (key, path) in key order; ``rules`` (key, path, host, verdict) in key order."""
    out: list[tuple[str, str] | None] = []
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    at = 0
    for key, path in urls:
        while at < len(rules) and rules[at][0] <= key:
            mine = rules[at][0]
            while stack and not mine.startswith(stack[-1][0]):
                stack.pop()
            if not stack or stack[-1][0] != mine:
                stack.append((mine, []))
            stack[-1][1].append(rules[at][1:])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for _, paths in stack:
            for p, h, verdict in paths:
                if path.startswith(p):
                    rank = (len(h) + len(p), len(h))
                    if best is None or rank > best[0]:
                        best = (rank, h + p, verdict)
        out.append(best and best[1:])
    return out


def _order(key: str) -> bytes:
    """Keys compare as Spark compares them."""
    return key.encode("utf-8", "surrogatepass")


def _to_partitions(parts: Iterator[pd.DataFrame], bounds: list[tuple[bytes, bytes, int]]) -> Iterator[pd.DataFrame]:
    """A copy of each rule for every partition that its interval of keys meets; these lie side by side."""
    highs = [high for _, high, _ in bounds]
    for p in parts:
        at, part = [], []
        for i, key in enumerate(p["key"]):
            key = _order(key)
            j = bisect_left(highs, key)
            while j < len(bounds) and (bounds[j][0] <= key or bounds[j][0].startswith(key)):
                at.append(i)
                part.append(bounds[j][2])
                j += 1
        yield p.iloc[at].assign(rule_part=part)[["rule_part", "key", "path", "host", "verdict"]].astype({"rule_part": "int32"})


def _sweep_part(key: tuple, urls: Iterator[pd.DataFrame], rules: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [r for chunk in rules for r in zip(chunk["key"], chunk["path"], chunk["host"], chunk["verdict"])]
    held.sort(key=lambda r: (_order(r[0]), r[1]))
    for chunk in urls:
        chunk = chunk.assign(order=[_order(k) for k in chunk["key"]]).sort_values("order", kind="stable")
        found = sweep(list(zip(chunk["key"], chunk["path"])), held)
        yield pd.DataFrame(
            {
                "row_id": chunk["row_id"].to_numpy(),
                "host": chunk["host"].to_numpy(),
                "path": chunk["path"].to_numpy(),
                "rule": [f and f[0] for f in found],
                "verdict": [f and f[1] for f in found],
            }
        )


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", parts: int | None = None
) -> DataFrame:
    """A row per page row: its id, host, path, the rule that decides (or null) and the verdict.

    Null urls and urls without ``://`` have an empty host and path; no rule fits
    them, as a rule with an empty or null host or a null path or verdict is no
    rule.  Rows that repeat are judged one by one.  An empty table gives an
    empty one.  Of rules that name the same host and path the verdict that comes
    first in order counts.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_column).alias("row_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", host_key(F.col("host")))
    )
    if parts is None:
        parts = max(1, min(MAX_PARTS, (pages.select(F.lit(1)).count() + rules.count()) // PART_ROWS + 1))
    cut = urls.repartitionByRange(parts, "key", F.xxhash64("row_id", "path")).withColumn("part", F.spark_partition_id())
    cut = store(cut)
    # a row per partition of the sweep, MAX_PARTS at most
    bounds = cut.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("high <> ''").collect()
    bounds = sorted((_order(r["low"]), _order(r["high"]), r["part"]) for r in bounds)
    copies = rules.select("key", "path", "host", "verdict").mapInPandas(
        lambda parts: _to_partitions(parts, bounds), "rule_part int, key string, path string, host string, verdict string"
    )
    judged = (
        cut.groupBy("part").cogroup(copies.groupBy("rule_part"))
        .applyInPandas(lambda k, a, b: next(_sweep_part(k, iter([a]), iter([b]))), f"row_id {cut.schema['row_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    )
    return judged.select(
        F.col("row_id").alias(id_column), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
