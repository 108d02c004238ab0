"""Seen-URI filters: exact, against a stored set, by fingerprint, with a Bloom filter before the exact check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: one aggregation with map-side combine, no sort of the groups."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First rows of keys that the stored set doesn't hold."""
    return first_by(rows, key, order).join(seen.select(key).distinct(), key, "left_anti").select(*rows.columns)


def by_fingerprint(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """As ``first_by`` with 64-bit fingerprints in place of keys: smaller, and wrong once in 2^64 / n pairs."""
    return first_by(rows.withColumn("_f", F.xxhash64(key)), "_f", order).drop("_f")


def bloom_words(seen: DataFrame, key: str, bits: int = 1 << 23, hashes: int = 4) -> DataFrame:
    """The set as a Bloom filter: at most bits / 64 rows of (word, bits), aggregated on the executors."""
    at = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits)) for k in range(hashes))))
    spots = seen.select(at.alias("_at")).distinct()
    return spots.groupBy(F.expr("shiftright(_at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("bits"))


def unseen_bloom(rows: DataFrame, seen: DataFrame, key: str, bits: int = 1 << 23, hashes: int = 4) -> DataFrame:
    """rows whose key the stored set doesn't hold: only those that a Bloom filter can't clear meet the exact join.

    The filter has a fixed size (1 MB by default), so it can be broadcast whatever the set's size.
    """
    words = F.broadcast(bloom_words(seen, key, bits, hashes))
    tagged = rows.withColumn("_id", F.xxhash64(key))
    probe = tagged.select("_id", key).distinct()
    for k in range(hashes):
        at = F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits))
        probe = probe.withColumn("_at", at).withColumn("word", F.expr("shiftright(_at, 6)")).join(words.withColumnRenamed("bits", f"_b{k}"), "word").filter(F.expr(f"(_b{k} & shiftleft(1L, cast(_at & 63 as int))) <> 0")).drop("word", "_at", f"_b{k}")
    held = probe.join(seen.select(key).distinct(), key, "left_semi").select(key)
    return rows.join(held, key, "left_anti").select(*rows.columns)


def forget(seen: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return seen.join(gone.select(key), key, "left_anti")


def force(fresh: DataFrame, forced: DataFrame) -> DataFrame:
    """Rows that come through whether or not they were seen."""
    return fresh.unionByName(forced)
