"""Counters, distributions and reports of a crawl, as grouped aggregations.

fetches need: status, bytes, and the columns grouped by.  ``novel``, ``duplicate`` and ``not_modified`` say
how content relates to what was fetched before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import hops


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _sum(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def fetch_counters(status: Column, size: Column, attempts: Column | None = None) -> list[Column]:
    """Counters by outcome: of successes, failures, disregarded and retried URIs, robots denials, and bytes."""
    what = hops.outcome(status, attempts if attempts is not None else F.lit(0))
    return [
        F.count("*").alias("scheduled"),
        _count(what == "success").alias("successes"),
        _count(what == "failure").alias("failures"),
        _count(what == "disregard").alias("disregards"),
        _count(what == "retry").alias("retries"),
        _count(status > 0).alias("responses"),
        _count(status == -9998).alias("robots_denials"),
        _sum(what == "success", size).alias("success_bytes"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
    ]


def fetch_stats(fetches: DataFrame, keys: list[str], status: str = "status", size: str = "bytes") -> DataFrame:
    out = fetches.groupBy(*keys).agg(*fetch_counters(F.col(status), F.col(size)))
    finished = F.col("successes") + F.col("failures") + F.col("disregards")
    return out.withColumns({"finished": finished, "remaining": F.col("scheduled") - finished})


def fetch_stats_levels(fetches: DataFrame, keys: list[str], status: str = "status", size: str = "bytes") -> DataFrame:
    """The counters by each key alone and over all, in one pass of grouping sets."""
    sets = [[F.col(k)] for k in keys] + [[]]
    return fetches.groupingSets(sets, *(F.col(k) for k in keys)).agg(*fetch_counters(F.col(status), F.col(size)))


def crawled_bytes(fetches: DataFrame, kind: Column, size: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Bytes and URIs that were novel, duplicates by digest or not modified."""
    parts = []
    for name in ("novel", "duplicate", "not_modified"):
        parts += [_sum(kind == name, size).alias(f"{name}_bytes"), _count(kind == name).alias(f"{name}_urls")]
    return fetches.groupBy(*keys).agg(*parts, F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.count("*").alias("total_urls"))


def histogram(rows: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """(key, n) tallied; keys whose total is nought vanish."""
    return rows.groupBy(key).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n")).filter("n <> 0")


def merge_histograms(added: list[DataFrame], subtracted: list[DataFrame], key: str) -> DataFrame:
    """The sum of histograms minus others: partial aggregates combine as such."""
    signed = [h.select(key, "n") for h in added] + [h.select(key, (-F.col("n")).alias("n")) for h in subtracted]
    whole = signed[0]
    for h in signed[1:]:
        whole = whole.union(h)
    return histogram(whole, key, F.col("n"))


def distribution(rows: DataFrame, key: Column, name: str, size: Column | None = None) -> DataFrame:
    """URIs (and bytes) by a key, most first, then by key."""
    sums = [F.count("*").alias("urls")] + ([F.coalesce(F.sum(size), F.lit(0)).alias("bytes")] if size is not None else [])
    return rows.groupBy(key.alias(name)).agg(*sums).orderBy(F.desc("urls"), name)


def top(rows: DataFrame, key: str, value: str, n: int, version: str | None = None, smallest: bool = False) -> DataFrame:
    """The n keys of the largest (smallest) values; of a key's updates the one of the last version counts."""
    if version:
        rows = rows.groupBy(key).agg(F.max_by(value, version).alias(value))
    return rows.orderBy(F.asc(value) if smallest else F.desc(value), key).limit(n)


def hosts_report(hosts: DataFrame, stats: DataFrame, host: str = "host") -> DataFrame:
    """All hosts with their counters: those with finished URIs first, most first, then the rest by name."""
    joined = hosts.join(stats, host, "left").na.fill(0, [c for c in stats.columns if c != host])
    return joined.orderBy(F.desc("finished"), host)


def seeds_report(seeds: DataFrame, fetches: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """Seeds with status, whether they were crawled, and where they redirect; unfinished ones first.

    Status and redirect are looked up by URI, one row for each fetch and redirect of it; without tables for that, seeds
    hold their own, and URIs that were fetched more than once stay apart.
    """
    if fetches is None or redirects is None:
        return _seed_rows(seeds)
    joined = seeds.join(fetches.select("uri", "status"), "uri", "left").join(redirects.select(F.col("src").alias("uri"), F.col("dst").alias("redirect")), "uri", "left")
    return _seed_rows(joined)


def _seed_rows(seeds: DataFrame) -> DataFrame:
    status = F.coalesce(F.col("status"), F.lit(0))
    found = seeds.select("uri", status.alias("status"), F.when(status > 0, "CRAWLED").otherwise("NOTCRAWLED").alias("disposition"), F.when(status.isin(301, 302, 307, 308), F.col("redirect")).alias("redirect"))
    return found.orderBy(shifted_status(F.col("status")), "uri")


def shifted_status(status: Column) -> Column:
    """The order of statuses in the seeds report: negated and shifted by the largest int, wrapping as ints do."""
    shifted = -status.cast("long") - F.lit(2147483647).cast("long")
    return F.when(shifted < -2147483648, shifted + F.lit(4294967296).cast("long")).otherwise(shifted)


def queue_census(queues: DataFrame, state: str = "state") -> DataFrame:
    """One row: queues in each state, how deep they are, and how many wait for those that run."""
    states = ("in_process", "ready", "snoozed", "inactive", "ineligible", "retired", "exhausted")
    counts = [_count(F.col(state) == s).alias(s) for s in states]
    active = _count(F.col(state).isin("in_process", "ready", "snoozed"))
    waiting, running = active + _count(F.col(state) == "inactive"), _count(F.col(state).isin("in_process", "snoozed"))
    return queues.agg(F.count("*").alias("total"), *counts, active.alias("active"), F.max("count").alias("deepest"), F.avg("count").alias("average_depth"), F.try_divide(waiting, running).alias("congestion"))
