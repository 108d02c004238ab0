"""Revisits: what earlier fetches of a URI say about this one, and when to come again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_history(fetches: DataFrame, key: str, order: list[str], columns: list[str], length: int = 2) -> DataFrame:
    """fetches with ``history``: this and earlier fetches of the key, newest first, ``length`` at most."""
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - length, 0)
    return fetches.withColumn("history", F.reverse(F.collect_list(F.struct(*columns)).over(last)))


def identical_digest(history: Column, field: str = "digest") -> Column:
    """Whether the newest two fetches have the same digest; only those two count."""
    return F.coalesce(F.get(history, F.lit(0))[field] == F.get(history, F.lit(1))[field], F.lit(False))


def content_kind(fetches: DataFrame, key: str, order: list[str], status: str, digest: str) -> DataFrame:
    """fetches with ``kind``: not_modified (304), duplicate (digest of the fetch before) or novel."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(*order))
    kind = F.when(F.col(status) == 304, "not_modified").when(F.coalesce(before == F.col(digest), F.lit(False)), "duplicate").otherwise("novel")
    return fetches.withColumn("kind", kind)


def visits_and_versions(fetches: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """fetches with ``changed`` (null at the first visit), visits and versions so far."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = fetches.withColumn("changed", F.col(digest) != F.lag(digest).over(w))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumns({"visits": F.count("*").over(so_far), "versions": 1 + F.sum(F.coalesce(F.col("changed"), F.lit(False)).cast("int")).over(so_far)})


def wait_intervals(fetches: DataFrame, key: str, order: list[str], changed: Column, first: float = 86_400.0, least: float = 3_600.0, most: float = 2_592_000.0, faster: float = 1.5, slower: float = 1.5) -> DataFrame:
    """(key, wait): seconds to the next visit: shorter after each change, longer after each visit without one.

    A recurrence over each key's visits in order, folded in one expression.
    """
    visits = fetches.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, changed.alias("_c")))).alias("v"))

    def step(wait: Column, visit: Column) -> Column:
        new = F.when(visit["_c"].isNull(), F.lit(first)).when(visit["_c"], wait / faster).otherwise(wait * slower)
        return F.least(F.greatest(new, F.lit(least)), F.lit(most))

    return visits.select(key, F.aggregate("v", F.lit(first), step).alias("wait"))


def revisit_record(kind: Column) -> Column:
    """The kind of archive record for a fetch: a revisit if there is nothing new to store."""
    return F.when(kind == "not_modified", "revisit/server-not-modified").when(kind == "duplicate", "revisit/identical-payload-digest").otherwise("response")


def write_gate(status: Column, scheme: Column, kind: Column, skip_duplicates: bool = True) -> Column:
    """Why a fetch isn't written, as an annotation; null if it is."""
    return (
        F.when(status <= 0, "unwritten:status")
        .when(~scheme.isin("dns", "ftp", "http", "https", "whois"), "unwritten:scheme")
        .when(F.lit(skip_duplicates) & (kind == "duplicate"), "unwritten:identicalDigest")
    )


def upsert(history: DataFrame, fetched: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key, that of the last version."""
    both = history.unionByName(fetched)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("_r")).select("_r.*")
