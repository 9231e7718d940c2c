"""URL filter: rules by host and path, and gradient-boosted trees over lexical features for the rest.

The URLs that a rule decides are the labelled ones.  Trees are fitted on histograms: each feature has a
few bins, a level of a tree needs one aggregate by leaf, feature and bin, and only that aggregate, of a
size fixed by the parameters, reaches the driver.  So all labelled URLs are learned from.  A fitted model
is a column expression; scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import query, table

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
BINS = 16
FEATURES = ("length", "depth", "digits", "entropy", "params", "suffix", "site")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict; equally long ones in the given order.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        own = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append((own & F.startswith(path, F.lit(slash + rest)), verdict, rule))
    return (F.coalesce(*[F.when(fit, rule) for fit, _, rule in fits]),
            F.coalesce(*[F.when(fit, verdict) for fit, verdict, _ in fits]))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    n = F.length(text)
    def term(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                                     lambda total, c: total + F.when(c != "", term(c)).otherwise(0.0))).otherwise(0.0)


def _bin(value: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(value))).cast("int")


def lexical(rows: DataFrame) -> DataFrame:
    """Binned features of ``_url``, ``_host`` and ``_path`` and the two suffixes that have statistics."""
    url = F.coalesce("_url", F.lit(""))
    labels = F.split("_host", r"\.")
    n = F.length(url)
    return rows.withColumns({
        "length": _bin(n / 8),
        "depth": _bin(F.length("_path") - F.length(F.replace("_path", F.lit("/"), F.lit("")))),
        "digits": _bin(F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n * 32).otherwise(0)),
        "entropy": _bin((entropy(url) - 2) * 5),
        "params": _bin(F.when(F.locate("?", url) > 0, F.size(F.split(F.substring_index(F.substring_index(
            url, "#", 1), "?", -1), "&"))).otherwise(0)),
        "_suffix": F.element_at(labels, -1),
        "_site": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."),
    })


def suffix_rate(labelled: DataFrame, suffix: str, name: str) -> DataFrame:
    """Smoothed share of blocked URLs per suffix, in bins."""
    rate = (F.sum("_y") + 1) / (F.count(F.lit(1)) + 2)
    return labelled.groupBy(suffix).agg(_bin(rate * BINS).alias(name))


@dataclass
class Trees:
    """Boosted trees: for each tree its splits in order of making (leaf, feature, bin) and its leaf values."""

    prior: float
    trees: list[tuple[list[dict[int, tuple[str, int]]], dict[int, float]]]

    @staticmethod
    def walk(levels: list[dict[int, tuple[str, int]]], value, number: int = 1) -> Column:
        """Nested choices down a tree; leaf n has the children 2 n (up to the split's bin) and 2 n + 1."""
        if not levels:
            return F.lit(value(number))
        if number not in levels[0]:
            return Trees.walk(levels[1:], value, 2 * number)
        feature, cut = levels[0][number]
        return F.when(F.col(feature) <= cut, Trees.walk(levels[1:], value, 2 * number)).otherwise(
            Trees.walk(levels[1:], value, 2 * number + 1))

    @staticmethod
    def leaf(levels: list[dict[int, tuple[str, int]]]) -> Column:
        """Number of the leaf a row is in."""
        return Trees.walk(levels, lambda number: number)

    def margin(self) -> Column:
        total = F.lit(self.prior)
        for levels, values in self.trees:
            total = total + Trees.walk(levels, lambda number, v=values: float(v.get(number, 0.0)))
        return total


def boost(labelled: DataFrame, rounds: int = 8, depth: int = 2, rate: float = 0.4, smooth: float = 1.0) -> Trees:
    """Fit trees to ``_y`` (1 is block) over the binned features by Newton steps on the logistic loss.

    Equal rows are merged first and each tree's margins are kept with them, so a step reads a table of
    distinct feature vectors.  Without labelled rows the prior is "allow".
    """
    rows = stage(labelled.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_y")), "url-bins")
    n, y = rows.agg(F.sum("_n"), F.sum("_y")).first()
    n, y = n or 0, y or 0
    model = Trees(math.log((y + 0.5) / (n - y + 0.5)) if n else -1.0, [])
    if not 0 < y < n:
        return model
    named = F.expr("stack({}, {}) AS (feature, bin)".format(
        len(FEATURES), ", ".join(f"'{name}', {name}" for name in FEATURES)))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin()))
        graded = rows.select(*FEATURES, (F.col("_n") * p - F.col("_y")).alias("_g"), (F.col("_n") * p * (1 - p)).alias("_h"))
        levels: list[dict[int, tuple[str, int]]] = []
        for _ in range(depth):
            bins = (graded.select(Trees.leaf(levels).alias("leaf"), "_g", "_h", named).groupBy("leaf", "feature", "bin")
                    .agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))).collect()  # leaves x features x bins
            levels.append(_best_splits(bins, smooth))
        sums = graded.groupBy(Trees.leaf(levels).alias("leaf")).agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
        values = {r["leaf"]: -rate * r["g"] / (r["h"] + smooth) for r in sums.collect()}
        model.trees.append((levels, values))
    return model


def _best_splits(bins: list, smooth: float) -> dict[int, tuple[str, int]]:
    """The split of each leaf with the largest gain."""
    found: dict[int, tuple[float, str, int]] = {}
    groups: dict[tuple[int, str], list] = {}
    for row in bins:
        groups.setdefault((row["leaf"], row["feature"]), []).append(row)
    for (leaf, feature), rows in sorted(groups.items()):
        rows.sort(key=lambda r: r["bin"])
        g, h, left_g, left_h = sum(r["g"] for r in rows), sum(r["h"] for r in rows), 0.0, 0.0
        for row in rows[:-1]:
            left_g, left_h = left_g + row["g"], left_h + row["h"]
            gain = round(left_g ** 2 / (left_h + smooth) + (g - left_g) ** 2 / (h - left_h + smooth)
                         - g ** 2 / (h + smooth), 6)
            if gain > max(found.get(leaf, (0.0,))[0], 1e-3):
                found[leaf] = (gain, feature, row["bin"])
    return {leaf: (feature, cut) for leaf, (_, feature, cut) in found.items()}


def judge(rows: DataFrame, key: Column, url: Column, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_share`` (the trees' probability) of every row.

    A rule's verdict stands; elsewhere the trees block from a probability of one half.  Null and empty
    URLs have an empty host and path and are judged by the trees.  Other columns are ignored.
    """
    split = rows.select(key.alias("id"), url.alias("_url"), host_of(F.coalesce(url, F.lit(""))).alias("_host"),
                        path_of(F.coalesce(url, F.lit(""))).alias("_path"))
    rule, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    features = lexical(split.withColumns({"rule": rule, "_verdict": verdict})).drop("_url")
    features = stage(features.withColumn("_y", (F.col("_verdict") == "block").cast("int")), "url-features")
    labelled = features.where("_verdict IS NOT NULL")
    for suffix, name in (("_suffix", "suffix"), ("_site", "site")):
        rates = suffix_rate(labelled, suffix, name)
        features = features.join(rates, suffix, "left").withColumn(name, F.coalesce(name, F.lit(BINS // 2)))
    features = stage(features, "url-all-features")
    model = boost(features.where("_verdict IS NOT NULL"))
    share = 1 / (1 + F.exp(-model.margin()))
    return features.withColumn("block_share", share).select(
        "id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("_verdict", F.when(F.col("block_share") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "block_share")


@query("op10_urls")
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    found = judge(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"), RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "block_share")
