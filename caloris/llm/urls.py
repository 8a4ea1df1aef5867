"""URL filters as a sort-merge range join.

A host with its labels reversed, a zero byte and the path make a canonical key; a rule's key is a prefix of exactly the
keys it covers, so the rule is the interval from its key to the end of that prefix. A rule also fits subdomains, so a URL
probes with each of its host's suffixes. Rules and probes are range-partitioned and sorted together; a sweep keeps the
stack of rules whose interval is still open. What is open where a partition starts are the rules that are prefixes of its
first key: one equi-join on the prefixes of the partitions' first keys, no broadcast of the rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, only, staged

END = "\0"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(labels)), F.lit(END), path)


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: id, host, path, rule, verdict.

    rules has host, path (starting with /) and verdict. A rule fits its host and all subdomains of it if the URL's path
    starts with the rule's; of several the longest rule wins (host and path together), ties go to the one that sorts
    first. Without a rule: null and `default`. Null or malformed URLs have empty host and path and fit no rule, nor does a
    URL without a path. Repeated rows are judged each; null ids stay; other columns are ignored.
    """
    spark = pages.sparkSession
    base = only(pages, id=id_col, url=url_col)
    host, path = split_url(F.col("url").cast("string"))
    base = base.select("id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    base = staged(base)
    # each distinct URL is probed once
    distinct = base.where("host <> '' AND path <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _key(F.slice(labels, i, F.size(labels)), F.col("path")))
    probes = distinct.select(F.explode(suffixes).alias("key"), F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    name = F.concat("host", "path")
    known = rules.select(F.lower("host").alias("host"), "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL")
    opened = known.select(_key(F.split("host", r"\."), F.col("path")).alias("key"), F.lit(0).alias("kind"), "host", "path", name.alias("rule"), "verdict").dropDuplicates(["key", "verdict"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions") or 200)
    swept = staged(opened.unionByName(probes).repartitionByRange(n, "key", "kind", "host").sortWithinPartitions("key", "kind", "verdict", "host"))
    firsts = swept.groupBy(F.spark_partition_id().alias("pid")).agg(F.min("key").alias("first"))
    prefixes = firsts.select("pid", F.explode(F.sequence(F.lit(1), F.length("first"))).alias("size"), "first").select("pid", F.substring("first", F.lit(1), F.col("size")).alias("key"))
    carried: dict[int, list[tuple[str, str, str]]] = {}
    # one row per partition and enclosing rule: bounded by partitions times the depth of nesting
    for r in prefixes.join(opened, "key").orderBy("pid", "key", "verdict").collect():
        carried.setdefault(r["pid"], []).append((r["key"], r["rule"], r["verdict"]))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        stack: list[tuple[str, str, str]] = [*carried.get(TaskContext.get().partitionId(), ())]
        for batch in batches:
            keys, kinds, hosts, paths, names, verdicts = (batch.column(i).to_pylist() for i in range(6))
            out: list[tuple] = []
            for key, kind, host, path, name, verdict in zip(keys, kinds, hosts, paths, names, verdicts, strict=True):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, name, verdict))
                elif stack:
                    out.append((host, path, stack[-1][1], stack[-1][2]))
            cols = [*zip(*out, strict=True)] or [[]] * 4
            yield {"host": pa.array(cols[0], pa.string()), "path": pa.array(cols[1], pa.string()), "rule": pa.array(cols[2], pa.string()), "verdict": pa.array(cols[3], pa.string())}

    found = map_arrow(swept, sweep, "host string, path string, rule string, verdict string")
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("size"), "rule", "verdict")).alias("best"))
    out = base.join(best, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules from (host, path, verdict) triples."""
    return spark.createDataFrame([*rules], "host string, path string, verdict string")
