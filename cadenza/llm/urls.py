"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

A rule names a host and the beginning of a path. It fits its host and every subdomain when the path of the url
starts with the rule's. Each distinct (host, path) is expanded only into expressions of a shape (number of host
labels, length of path) that some rule has, so long hosts and paths do not multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\0", host, path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules by digest: the short prefix to join on, the whole digest, and the shape of the expression.

    ``rules`` has host, path and verdict. A rule without a host or verdict is left out, a null path is empty; of equal
    rules with both verdicts the block stands.
    """
    clean = rules.where("host is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict"
    )
    one = clean.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return one.select(
        F.substring(digest, 1, 8).alias("short"), digest.alias("digest"), F.concat("r_host", "r_path").alias("rule"), "r_verdict",
        F.length("r_host").alias("host_length"), F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("path_length"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row: the longest fitting rule wins, else the default.

    Equal lengths go to the rule with the longer host. Copies of a url are judged once. Null urls and urls without
    ``://`` have an empty host and path, which only the default judges; repeated rows stay repeated.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    known = prepared_rules(rules)
    shapes = known.agg(F.collect_set(F.struct("labels", "path_length"))).scalar()
    distinct = split.distinct().withColumn("part", F.split("host", r"\."))
    wide = distinct.select("host", "path", "part", F.explode(shapes).alias("shape"))
    fits = (F.size("part") >= F.col("shape.labels")) & (F.length("path") >= F.col("shape.path_length"))
    suffix = F.array_join(F.slice("part", -F.col("shape.labels"), F.col("shape.labels")), ".")
    prefix = F.substr("path", F.lit(1), F.col("shape.path_length"))
    asked = wide.where((F.col("host") != "") & fits).select("host", "path", _digest(suffix, prefix).alias("asked")).withColumn("short", F.substring("asked", 1, 8))
    # the short prefix finds candidates, the whole digest confirms them
    hits = asked.join(known, "short").where(F.col("asked") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "r_verdict")).alias("best")
    )
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict")
    )
