"""URL filter: allow and block rules, and for the rest a logistic regression on hashed character n-grams of host and path.

Everything is built-in DataFrame expressions. The model is fitted by full-batch gradient steps with per-bucket step sizes on a small
labelled URL table, whose rows are bounded by ``max_labelled``; a step is two aggregations of that table. The weights are one
array of ``buckets`` doubles, so what reaches the driver has a fixed size whatever the number of pages. Scoring is one projection.

Defined cases: a null url, or one without ``://``, has an empty host and path, meets no rule and gets the model's verdict for empty
text (its bias). Repeated rows repeat their results; an empty page table gives an empty result; without labelled URLs, or with
labels of one kind only, the bias alone decides (no labels: allow).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, or nulls. A rule is (verdict, host, path); it fits its host and all
    subdomains when the path starts with the rule's path."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return text, verdict


def _gram(mark: str, text: Column, n: int, buckets: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int")


def ngrams(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Distinct hashed character n-grams of host and of path, kept apart by their mark, as an array of bucket numbers."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in sizes:
            last = F.length(text) - (n - 1)
            grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), _gram(mark, text, n, buckets))
            parts.append(F.when(last >= 1, grams).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.concat(*parts))


def fit(labelled: DataFrame, sizes=(2, 3, 4), buckets: int = 4096, steps: int = 8, rate: float = 0.8, ridge: float = 1e-3, max_labelled: int = 4000) -> tuple[list[float], float]:
    """Weights and bias from a table (host, path, block boolean). Of more than ``max_labelled`` rows those with the smallest hashes count."""
    rows = (
        labelled.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("block").cast("double").alias("y"))
        .filter(F.col("y").isNotNull())
        .orderBy(F.xxhash64("host", "path"), "host", "path", "y")
        .limit(max_labelled)
        .select("y", ngrams(F.col("host"), F.col("path"), sizes, buckets).alias("grams"))
    )
    rows = materialize(rows)  # at most ``max_labelled`` short rows, read by every step
    n, positive = rows.agg(F.count("y"), F.sum("y")).first()
    weights = [0.0] * buckets
    if not n:
        return weights, -1.0
    bias = math.log((positive + 0.5) / (n - positive + 0.5))
    squares = [0.0] * (buckets + 1)
    if 0 < positive < n:
        for _ in range(steps):
            miss = probability(F.col("grams"), weights, bias) - F.col("y")
            # bucket -1 stands for the bias; at most one row a bucket comes back
            slope = rows.select(miss.alias("miss"), F.explode(F.array_append("grams", F.lit(-1))).alias("bucket")).groupBy("bucket").agg(F.sum("miss").alias("g")).collect()
            for bucket, g in slope:
                g = g / n + (ridge * weights[bucket] if bucket >= 0 else 0.0)
                squares[bucket] += g * g
                step = rate * g / (math.sqrt(squares[bucket]) + 1e-9)
                if bucket >= 0:
                    weights[bucket] -= step
                else:
                    bias -= step
    return weights, bias


def probability(grams: Column, weights: list[float], bias: float) -> Column:
    """Probability of *block*. The n-grams' weights are averaged with a square-root length correction, so long paths do not saturate."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # a constant of fixed size
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, url: str = "url", carry: list[str] | None = None, sizes=(2, 3, 4), buckets: int = 4096, **fitting) -> DataFrame:
    """``carry`` columns, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``block_probability`` (null where a rule decided).

    Without a ``labelled`` table (host, path, block) the URLs that a rule decides are the labels.
    """
    carry = carry or []
    host, path = host_and_path(F.col(url))
    split = pages.select(*carry, host.alias("host"), path.alias("path"))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", text.alias("rule"), verdict.alias("_ruled"))
    if labelled is None:
        labelled = ruled.filter(F.col("_ruled").isNotNull()).select("host", "path", (F.col("_ruled") == "block").alias("block"))
    weights, bias = fit(labelled, sizes, buckets, **fitting)
    p = F.when(F.col("_ruled").isNull(), probability(ngrams(F.col("host"), F.col("path"), sizes, buckets), weights, bias))
    scored = ruled.select("*", p.alias("block_probability"))
    final = F.coalesce(F.col("_ruled"), F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(*carry, "host", "path", "rule", final.alias("verdict"), "block_probability")
