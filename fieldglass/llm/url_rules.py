"""URL filters by a sort-merge range join of nested rules.

A rule's host, label by label from the right, is a prefix of the keys of its host and all
subdomains, so it covers one interval of the sorted keys; intervals nest or are disjoint. Urls are
dealt by ranges of (key, salt), rules are copied to the ranges their interval touches, and a sweep
over each sorted range keeps the stack of open rules.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.tables import keep_once, partitions

# The rules of the contract, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
LABEL_END = "\x01"  # sorts before any character of a label, so a host comes before its subdomains
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 1 << 16


def host_of(url: str):
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.when(F.expr(f"locate('://', {url}) > 0"), host).otherwise("")


def path_of(url: str):
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    return F.when(F.expr(f"locate('://', {url}) > 0"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def reversed_host(host: str):
    """Labels from the right, each closed by LABEL_END; the empty host has the empty key."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(F.col(host) == "", F.lit("")).otherwise(F.concat(F.array_join(labels, LABEL_END), F.lit(LABEL_END)))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with its own;
    the longest host and path together wins, then the longer host, then the first verdict by name.
    Without a rule the verdict is `default` and the rule null. Null urls and urls without :// have an
    empty host and path, which no rule fits. Repeated rows and null ids stay rows of their own; rules
    with null parts are ignored; of a rule given twice with both verdicts, allow is kept.
    Urls of one hot host, or one hot url, spread over ranges by a salt.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    urls = pages.select(F.col(id_column).alias("id"), F.coalesce(url_column, F.lit("")).alias("url"))
    urls = urls.select("id", host_of("url").alias("host"), path_of("url").alias("path")).withColumns({
        "key": reversed_host("host"), "salt": F.pmod(F.xxhash64("id", "host", "path"), F.lit(SALTS))})
    dealt = keep_once(urls.repartitionByRange(n, "key", "salt").withColumn("part", F.spark_partition_id()), "urls")
    # One row per range, as many as partitions.
    ends = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    clean = rules.dropna(subset=["verdict", "host", "path"]).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = clean.withColumn("key", reversed_host("host")).withColumn("after", F.concat("key", F.lit("\U0010ffff")))
    places = ranges_touched(keyed, ends)
    events = dealt.select("part", "key", F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"), "host", "path",
                          F.lit(None).cast("string").alias("verdict")).unionByName(
        places.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "host", "path", "verdict"))
    ordered = events.repartition(n, "part").sortWithinPartitions("part", "key", "kind")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = None, []
        for batch in batches:
            rows = []
            for p, key, kind, page, host, path, verdict in zip(
                batch["part"], batch["key"], batch["kind"], batch["id"], batch["host"], batch["path"], batch["verdict"], strict=True
            ):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(OpenRules(key, host))
                    stack[-1].add(path, verdict)
                else:
                    best = max((hit for level in stack if (hit := level.longest(path))), default=None)
                    rows.append((page, host, path, best and best[2] + best[3], best[4] if best else default))
            yield pd.DataFrame(rows, columns=["id", "host", "path", "rule", "verdict"], dtype=object)

    swept = ordered.mapInPandas(sweep, "id string, host string, path string, rule string, verdict string")
    return swept.withColumn("id", F.col("id").cast(dealt.schema["id"].dataType)).withColumnRenamed("id", id_column)


def ranges_touched(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """Copies of the rules, one for each range whose keys meet [key, after).

    The ranges' ends, as few as partitions, come to the driver. They are in order, so a rule touches
    consecutive ranges, found by two binary searches: the first that ends at or after its key, and
    the last that starts before its end.
    """
    found = sorted((r["low"], r["high"], r["part"]) for r in ends.collect())
    lows, highs, parts = [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = [bisect_left(highs, k) for k in batch["key"]]
            last = [bisect_left(lows, a) for a in batch["after"]]
            batch["part"] = [parts[i:j] for i, j in zip(first, last, strict=True)]
            yield batch.explode("part").dropna(subset=["part"]).astype({"part": "int32"})[["part", "key", "host", "path", "verdict"]]

    return keyed.mapInPandas(copies, "part int, key string, host string, path string, verdict string")


class OpenRules:
    """The rules of one host on the stack, by path."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)
        self.paths[path] = verdict

    def longest(self, path: str) -> tuple | None:
        for n in self.lengths:
            if n <= len(path) and (verdict := self.paths.get(path[:n])) is not None:
                return len(self.host) + n, len(self.host), self.host, path[:n], verdict
        return None
