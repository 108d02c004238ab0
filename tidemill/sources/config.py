"""Small configuration files as DataFrames: public suffixes, cookies, crawl maps, precedences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import uris

from .lines import entries


def public_suffixes(lines: DataFrame) -> DataFrame:
    """(suffix, kind): kind is rule, wildcard (one label more is the suffix) or exception (it is none)."""
    found = entries(lines, ignore=r"^\s*(?://.*)?$")
    kind = F.when(F.col("entry").startswith("!"), "exception").when(F.col("entry").startswith("*."), "wildcard").otherwise("rule")
    return found.select(F.lower(F.regexp_replace("entry", r"^(?:!|\*\.)", "")).alias("suffix"), kind.alias("kind"))


def assigned_domains(rows: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """rows with ``domain``: the public suffix of their host and one label, by a hash join over the ladder of parents."""
    labels = F.split(F.col(host), r"\.")
    hosts = rows.select(F.col(host).alias("_h")).distinct()
    ladder = hosts.select("_h", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("_h", r"\."))), lambda k: F.array_join(F.slice(F.split("_h", r"\."), k, F.size(F.split("_h", r"\."))), "."))).alias("_k", "suffix"))
    # how many labels before it the domain has; the longest rule wins, an exception over all
    n = F.size(F.split("suffix", r"\."))
    length = F.when(F.col("kind") == "exception", n).when(F.col("kind") == "wildcard", n + 2).otherwise(n + 1)
    best = ladder.join(suffixes, "suffix").groupBy("_h").agg(F.max_by(length, F.when(F.col("kind") == "exception", 1000).otherwise(length)).alias("_n"))
    out = rows.join(best, rows[host] == best["_h"], "left")
    size = F.size(labels)
    kept = F.coalesce("_n", F.lit(2))
    domain = F.when(uris.is_quad(F.col(host)) | (size < kept), F.col(host)).otherwise(F.array_join(F.slice(labels, size - kept + 1, kept), "."))
    return out.withColumn("domain", domain).drop("_h", "_n")


COOKIE = ("domain", "tail", "path", "secure", "expires", "name", "value")


def cookies(lines: DataFrame) -> DataFrame:
    """Cookies of tab-separated files with seven columns."""
    part = F.split("value", "\t")
    named = [F.get(part, F.lit(k)).alias(n) for k, n in enumerate(COOKIE)]
    found = lines.filter(~F.regexp_like("value", F.lit(r"^\s*(?:#.*)?$"))).filter(F.size(part) == 7).select(*named)
    return found.withColumns({"tail": F.col("tail") == "TRUE", "secure": F.col("secure") == "TRUE", "expires": F.timestamp_seconds(F.col("expires").try_cast("long"))})


def cookie_line(row: dict[str, Column]) -> Column:
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    return F.concat_ws("\t", row["domain"], flag(row["tail"]), row["path"], flag(row["secure"]), F.unix_timestamp(row["expires"]).cast("string"), row["name"], row["value"])


def pairs(lines: DataFrame, first: str, second: str) -> DataFrame:
    """Two columns of lines with two words: crawl maps (boundary, target), precedences (uri, precedence)."""
    part = F.split(F.trim("value"), r"\s+")
    return lines.filter(~F.regexp_like("value", F.lit(r"^\s*(?:#.*)?$"))).select(F.get(part, F.lit(0)).alias(first), F.get(part, F.lit(1)).alias(second)).dropna()
