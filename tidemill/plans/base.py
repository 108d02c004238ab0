"""Tables that the catalogue's queries derive from the driver's ones, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import uris

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOPS = ("", "L", "LL", "LLE", "LER", "LEEX", "LLLLP")
STATUSES = {0: 404, 1: 301, 2: 304, 3: -9998, 4: -2, 5: -5003}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of its result."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as fetched URIs: (page_id, uri, host, hops, via, status, bytes, digest); statuses and paths follow from the id."""
    pages = table(spark, sf_dir, "pages")
    code = F.pmod("page_id", F.lit(10))
    status = F.lit(200)
    for k, v in STATUSES.items():
        status = F.when(code == k, v).otherwise(status)
    hops = F.element_at(F.array(*map(F.lit, HOPS)), (F.pmod("page_id", F.lit(7)) + 1).cast("int"))
    via = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("via"))
    rows = pages.select("page_id", F.col("url").alias("uri"), uris.host(F.col("url")).alias("host"), hops.alias("hops"), status.alias("status"), F.length("html").cast("long").alias("bytes"), F.sha1("html").alias("digest"))
    return rows.join(via, "page_id", "left")


FETCHES = """
fetches as (
    select p.page_id, p.url as uri, regexp_replace(regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '') as host,
        ['', 'L', 'LL', 'LLE', 'LER', 'LEEX', 'LLLLP'][(p.page_id % 7) + 1] as hops,
        case p.page_id % 10 when 0 then 404 when 1 then 301 when 2 then 304 when 3 then -9998 when 4 then -2 when 5 then -5003 else 200 end as status,
        length(p.html)::bigint as bytes, sha1(p.html) as digest, v.url as via
    from pages p left join pages v on v.page_id = p.page_id - 1
)
"""

#: The sort key of pages' URLs, which have neither user information nor dotted quads as hosts.
SURT = """regexp_extract(lower({u}), '^([a-z]+://)', 1) || '(' || array_to_string(list_reverse(string_split(regexp_extract(lower({u}), '^[a-z]+://([^/:?#]+)', 1), '.')), ',') || ',' || regexp_extract(lower({u}), '^[a-z]+://[^/:?#]+(:[0-9]+)?', 1) || ')' || regexp_extract(lower({u}), '^[a-z]+://[^/?#]+(/.*)$', 1)"""


def surt_sql(column: str) -> str:
    return SURT.format(u=column)
