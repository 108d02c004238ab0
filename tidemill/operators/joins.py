"""Joins that crawls need beside equality: by prefix, by nearest key, by range, along discovery paths.

Prefixes are looked up as a hash join: a row is repeated for each prefix length that occurs and is short
enough, so no nested loop compares everything with everything, whatever the number of prefixes.  The set of
lengths is bounded by the longest key; the rule sides aren't broadcast by hand, Spark decides by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import uris

from .scratch import staged


def prefix_lengths(prefixes: DataFrame, prefix: str) -> list[int]:
    """The lengths that occur: a few hundred numbers at most, as keys are no longer than URIs may be."""
    rows = prefixes.select(F.length(prefix).alias("n")).distinct().filter(F.col("n") <= uris.MOST_CHARS).collect()
    return sorted(r.n for r in rows)


def all_prefixes(rows: DataFrame, key: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """rows joined with every prefix of their key: the columns of both."""
    lengths = prefix_lengths(prefixes, prefix)
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(key))
    probed = rows.withColumn("_n", F.explode(fits)).withColumn("_p", F.substr(key, F.lit(1), F.col("_n")))
    return probed.join(prefixes, probed["_p"] == prefixes[prefix]).drop("_n", "_p")


def prefix_semi(rows: DataFrame, key: str, prefixes: DataFrame, prefix: str = "prefix", anti: bool = False) -> DataFrame:
    """rows whose key has (or, anti, hasn't) a prefix in the set; each row is kept once.

    One equality for each length that occurs, over distinct keys: the rows themselves are shuffled once.
    """
    found = all_prefixes(rows.select(F.col(key).alias("_key")).distinct(), "_key", prefixes.select(prefix).distinct(), prefix).select("_key").distinct()
    return rows.join(found, rows[key] == found["_key"], "left_anti" if anti else "left_semi")


def longest_prefix(rows: DataFrame, key: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """rows with the columns of the longest prefix of their key; nulls where there is none."""
    keys = rows.select(F.col(key).alias("_key")).distinct()
    best = all_prefixes(keys, "_key", prefixes, prefix).groupBy("_key").agg(F.max_by(F.struct(*prefixes.columns), F.length(prefix)).alias("_best"))
    return rows.join(best, rows[key] == best["_key"], "left").select(*(rows[c] for c in rows.columns), *(F.col(f"_best.{c}").alias(c) for c in prefixes.columns))


def minimise_prefixes(prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """The prefixes that no other one subsumes."""
    distinct = prefixes.select(prefix).distinct()
    longer = all_prefixes(distinct.withColumnRenamed(prefix, "_long"), "_long", distinct, prefix).filter(F.col("_long") != F.col(prefix))
    return distinct.join(longer.select(F.col("_long").alias(prefix)), prefix, "left_anti")


def next_key(rows: DataFrame, key: str, marks: DataFrame, mark: str, value: str) -> DataFrame:
    """rows with the value of the least mark not below their key; beyond the last mark, of the first one.

    Marks are boundaries of a lexical map: few, so they are sorted into a literal array and searched.
    """
    sorted_marks = [(r[0], r[1]) for r in marks.select(mark, value).orderBy(mark).collect()]
    if not sorted_marks:
        return rows.withColumn(value, F.lit(None).cast("string"))
    table = F.array(*(F.struct(F.lit(a).alias("m"), F.lit(b).alias("v")) for a, b in sorted_marks))
    ahead = F.filter(table, lambda x: x["m"] >= F.col(key))
    return rows.withColumn(value, F.coalesce(F.get(ahead, F.lit(0))["v"], F.lit(sorted_marks[0][1])))


def as_of(rows: DataFrame, by: str, at: str, marks: DataFrame, mark_at: str, values: list[str]) -> DataFrame:
    """rows with the values of the last mark of their key at or before them: one sort of the union, no range join."""
    left = rows.select(F.col(by).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_s"), F.struct(*rows.columns).alias("_row"), *(F.lit(None).cast(marks.schema[v].dataType).alias(v) for v in values))
    right = marks.select(F.col(by).alias("_k"), F.col(mark_at).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *values)
    order = Window.partitionBy("_k").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("_s") == 0, F.struct(*values)), ignorenulls=True).over(order)
    both = left.unionByName(right).withColumn("_v", packed).filter(F.col("_s") == 1)
    return both.select("_row.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def range_lookup(rows: DataFrame, number: str, ranges: DataFrame, low: str = "low", high: str = "high", bucket: int = 1 << 16) -> DataFrame:
    """rows with the columns of the ranges that hold their number: ranges are repeated for the buckets they touch."""
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    probed = rows.withColumn("_b", F.floor(F.col(number) / bucket))
    return probed.join(spread, "_b").filter((F.col(number) >= F.col(low)) & (F.col(number) <= F.col(high))).drop("_b")


def suffix_ladder(name: Column) -> Column:
    """A host and its parent domains, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def domain_semi(rows: DataFrame, host: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """rows whose host is one of the domains or below one."""
    hosts = rows.select(F.col(host).alias("_h")).distinct()
    found = hosts.withColumn("_d", F.explode(suffix_ladder(F.col("_h")))).join(domains.select(F.col(domain).alias("_d")).distinct(), "_d", "left_semi").select("_h").distinct()
    return rows.join(found, rows[host] == found["_h"], "left_semi")


def overlay(rows: DataFrame, row_id: str, key: str, overlays: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Settings of each row: overlays(prefix, ord, key, value) of all its prefixes, the highest ord of each setting wins."""
    probed = all_prefixes(rows.select(F.col(row_id).alias("_id"), F.col(key).alias("_key")), "_key", overlays.withColumnRenamed("key", "_setting"))
    won = probed.groupBy("_id").pivot("_setting", list(defaults)).agg(F.max_by("value", "ord"))
    out = rows.join(won, rows[row_id] == won["_id"], "left").drop("_id")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v).cast("string")) for k, v in defaults.items()})


def dimension(rows: DataFrame, key: str, table: DataFrame, default: dict[str, Column] | None = None) -> DataFrame:
    """A lookup that keeps all rows; what isn't found gets defaults."""
    out = rows.join(table, key, "left")
    return out.withColumns({k: F.coalesce(F.col(k), v) for k, v in (default or {}).items()})


def with_via(rows: DataFrame, columns: list[str], uri: str = "uri", via: str = "via", order: list[str] | None = None) -> DataFrame:
    """rows with columns of the row that led to them, prefixed ``via_``; of several rows of a URI the first in order."""
    parent = rows.select(F.col(uri).alias("_u"), F.struct(*(F.col(c).alias(f"via_{c}") for c in columns)).alias("_via"), F.struct(*(order or columns)).alias("_order"))
    parent = parent.groupBy("_u").agg(F.min_by("_via", "_order").alias("_via")).select("_u", "_via.*")
    return rows.join(parent, rows[via] == parent["_u"], "left").drop("_u")


def paths_to_seeds(rows: DataFrame, uri: str = "uri", via: str = "via") -> DataFrame:
    """(uri, seed, depth, path): every URI with the seed it was found from and the way there, by joins to a fixed point.

    Each round follows twice as many steps as the one before, so a path of n hops takes log2(n) rounds; they end
    when no row has a parent left.  URIs whose way back runs into a cycle have no seed and are left out.
    """
    looped = F.coalesce(F.array_contains("path", F.col("up")), F.lit(False)) | (F.size(F.array_distinct("path")) < F.size("path"))
    # a loop is known within twice its length; its rows follow it no further
    cut = lambda df: df.withColumn("loop", F.col("loop") | looped).withColumns({"up": F.when(~F.col("loop"), F.col("up")), "path": F.when(~F.col("loop"), F.col("path")).otherwise(F.array("uri"))})
    first = rows.select(F.col(uri).alias("uri"), F.col(via).alias("up"), F.array(F.col(uri)).alias("path"), F.lit(False).alias("loop")).dropDuplicates(["uri"])
    done = staged(cut(first).withColumn("more", F.col("up").isNotNull()), "paths")
    while not done.filter("more").isEmpty():
        above = done.select(F.col("uri").alias("_u"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("loop").alias("_loop"))
        joined = done.join(above, done["up"] == above["_u"], "left")
        found = F.col("_u").isNotNull()
        stepped = joined.select("uri", F.when(found, F.col("_up")).otherwise(F.col("up")).alias("up"), F.when(found, F.concat("path", "_path")).otherwise(F.col("path")).alias("path"), F.coalesce(F.col("loop") | F.col("_loop"), F.col("loop")).alias("loop"), found.alias("found"))
        done = staged(cut(stepped).withColumn("more", F.col("found") & F.col("up").isNotNull()).drop("found"), "paths")
    return done.filter("not loop").select("uri", F.element_at("path", -1).alias("seed"), (F.size("path") - 1).alias("depth"), F.reverse("path").alias("path"))
