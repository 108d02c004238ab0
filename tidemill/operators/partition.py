"""Which crawler a URI belongs to: by hash, by lexical range, by a ring; what is diverted to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import uris

FOREIGN = -5002


def by_hash(uri: Column, crawlers: int, reduce: bool = True) -> Column:
    """Number of the crawler, by the registered domain (so that one crawler has all its hosts) or the queue."""
    key = uris.assigned_domain(uri) if reduce else uris.class_key(uri)
    return F.pmod(spot(key), F.lit(crawlers)).cast("int")


def spot(key: str | Column) -> Column:
    """A number of 32 bits that any other engine can work out too."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def ring(names: list[str], replicas: int = 128) -> list[tuple[int, str]]:
    """Points of a consistent-hash ring: removing a crawler moves only its own share."""
    import hashlib

    points = [(int.from_bytes(hashlib.md5(f"{n}/{k}".encode()).digest()[:4], "big"), n) for n in sorted(names) for k in range(replicas)]
    return sorted(points)


def by_ring(rows: DataFrame, key: str, names: list[str], replicas: int = 128) -> DataFrame:
    """rows with ``crawler``: the ring's first point at or after the key's hash, by a range join over buckets."""
    points = ring(names, replicas)
    arcs, low = [], 0
    for at, name in points:
        if at >= low:
            arcs.append((low, at, name))
            low = at + 1
    arcs.append((low, (1 << 32) - 1, points[0][1]))
    table = rows.sparkSession.createDataFrame(arcs, "low long, high long, crawler string")
    from .joins import range_lookup

    return range_lookup(rows.withColumn("_spot", spot(key)), "_spot", table, bucket=1 << 24).select(*rows.columns, "crawler")


def divert(rows: DataFrame, crawler: Column, local: object) -> tuple[DataFrame, DataFrame]:
    """(what stays, what other crawlers get with the status that says so)."""
    here = F.coalesce(crawler == local, F.lit(False))
    return rows.filter(here), rows.filter(~here).withColumns({"target": crawler, "status": F.lit(FOREIGN)})


def mirror_path(uri: Column, most: int = 255) -> Column:
    """Where a mirror keeps a URI: host, then its path; a name for directories, no names that file systems lack."""
    way = F.regexp_replace(uris.path(uri), "^/+|/+$", "")
    name = F.when(uris.path(uri).endswith("/") | (way == ""), F.concat_ws("/", F.nullif(way, F.lit("")), F.lit("index.html"))).otherwise(way)
    asked = F.when(uris.query(uri) != "", F.concat(F.lit("?"), uris.query(uri))).otherwise("")
    safe = F.regexp_replace(F.concat(name, asked), r'[\x00-\x1F<>:"|?*\\]', "_")
    parts = F.transform(F.split(F.regexp_replace(safe, r"(^|/)\.{1,2}(?=/|$)", "$1_"), "/"), lambda p: F.left(p, F.lit(most)))
    port = F.when(uris.port(uri).isNotNull(), F.concat(F.lit("_"), uris.port(uri).cast("string"))).otherwise("")
    return F.concat(uris.host(uri), port, F.lit("/"), F.array_join(parts, "/"))
