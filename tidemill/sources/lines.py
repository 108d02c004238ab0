"""Line formats of crawls as DataFrames: seed lists, journals, crawl logs, prefix files; readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text, uris

CRAWL_LOG = ("ts", "status", "size", "uri", "hops", "via", "mime", "thread", "began", "digest", "source_tag", "annotations")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain or gzipped files."""
    return spark.read.text(path)


def entries(lines: DataFrame, ignore: str = r"^\s*(?:#.*)?$", take: str = r"^\s*(\S+)", value: str = "value") -> DataFrame:
    """What a pattern takes from lines that another one doesn't ignore."""
    return lines.filter(~F.regexp_like(value, F.lit(ignore))).select(F.regexp_extract(value, take, 1).alias("entry"))


def seeds(lines: DataFrame) -> DataFrame:
    """Seeds: lines that begin with a letter or digit, with http:// where no scheme is given; each is its own source tag."""
    found = entries(lines).filter(F.regexp_like("entry", F.lit("^[A-Za-z0-9]")))
    uri = uris.add_http(F.col("entry"))
    return found.select(uri.alias("uri"), F.lit(True).alias("is_seed"), F.lit(2).alias("scheduling"), uri.alias("source_tag"))


def directives(lines: DataFrame) -> DataFrame:
    """Prefixes of lines that begin with + (accept) or - (reject)."""
    found = entries(lines).filter(F.regexp_like("entry", F.lit("^[+-]")))
    return found.select(uris.surt_prefix(F.substr("entry", F.lit(2))).alias("prefix"), F.when(F.col("entry").startswith("+"), "ACCEPT").otherwise("REJECT").alias("decision"))


def surt_prefixes(lines: DataFrame, deduce: bool = False) -> DataFrame:
    """Prefixes of a file of + lines in sort-key form; with ``deduce`` other lines are seeds that imply theirs."""
    found = entries(lines)
    direct = found.filter(F.col("entry").startswith("+")).select(F.lower(F.substr("entry", F.lit(2))).alias("prefix"))
    if not deduce:
        return direct.union(found.filter(F.col("entry").contains("(")).select(F.lower("entry")))
    return direct.union(found.filter(F.regexp_like("entry", F.lit("^[A-Za-z0-9]"))).select(uris.surt_prefix(F.col("entry"))))


def journal(lines: DataFrame) -> DataFrame:
    """(tag, uri, hops, via) of journal lines such as ``F+ http://a/ LL http://b/``."""
    shape = r"^(\S{2})\s+(\S+)(?:\s+(\S*))?(?:\s+(\S+))?"
    part = lambda k: F.nullif(F.regexp_extract("value", shape, k), F.lit(""))
    return lines.filter(F.regexp_like("value", F.lit(r"^F\S\s"))).select(part(1).alias("tag"), part(2).alias("uri"), part(3).alias("hops"), part(4).alias("via"))


def journal_line(tag: Column, uri: Column, hops: Column, via: Column) -> Column:
    return F.trim(F.concat_ws(" ", tag, uri, F.coalesce(hops, F.lit("")), F.coalesce(via, F.lit(""))))


def pending(events: DataFrame) -> DataFrame:
    """What a replayed journal leaves to do: URIs added that no success, failure or disregard has finished."""
    done = events.filter("tag in ('Fs', 'Ff', 'Fd')").select("uri").distinct()
    added = events.filter("tag = 'F+'").groupBy("uri").agg(F.min_by("hops", "seq").alias("hops"), F.min_by("via", "seq").alias("via"), F.min("seq").alias("seq"))
    return added.join(done, "uri", "left_anti")


def included(events: DataFrame) -> DataFrame:
    """URIs that a journal marks as seen."""
    return events.filter("tag in ('F+', 'Fi', 'Fs')").select("uri").distinct()


def format_crawl_log(rows: DataFrame) -> DataFrame:
    """Lines of twelve fields; what is missing is a dash."""
    dash = text.dash_if_none
    fields = (
        text.iso_date(F.col("ts"), millis=True), text.pad(F.col("status"), 5), text.pad(dash(F.col("size")), 10), F.col("uri"), dash(F.col("hops")), dash(F.col("via")), text.mime(F.col("mime")),
        F.concat(F.lit("#"), text.pad(F.col("thread"), 3, "0")), dash(F.col("began")), dash(F.col("digest")), dash(F.col("source_tag")), dash(F.array_join("annotations", ",")),
    )
    return rows.select(F.concat_ws(" ", *fields).alias("value"))


def parse_crawl_log(lines: DataFrame) -> DataFrame:
    """Typed fields of crawl log lines; dashes are null, lines with fewer fields are dropped."""
    part = F.split(F.trim("value"), r"\s+")
    field = {n: F.nullif(F.get(F.col("_p"), F.lit(k)), F.lit("-")) for k, n in enumerate(CRAWL_LOG)}
    field |= {"ts": F.try_to_timestamp(field["ts"]), "status": field["status"].try_cast("int"), "size": field["size"].try_cast("long"), "thread": F.regexp_extract(field["thread"], r"#(\d+)", 1).try_cast("int"), "annotations": F.split(field["annotations"], ",")}
    return lines.select(part.alias("_p")).filter(F.size("_p") >= 12).select(*(c.alias(n) for n, c in field.items()))


def grep(lines: DataFrame, pattern: str, number: str = "line_no", skip: int = 0, most: int = 1000) -> DataFrame:
    """Lines that a pattern is found in, in order: a page of them."""
    return lines.filter(F.regexp_like("value", F.lit(pattern))).orderBy(number).offset(skip).limit(most)


def tail(lines: DataFrame, n: int, number: str = "line_no") -> DataFrame:
    return lines.orderBy(F.desc(number)).limit(n).orderBy(number)


def first_line(lines: DataFrame, pattern: str, number: str = "line_no") -> DataFrame:
    return lines.filter(F.regexp_like("value", F.lit(pattern))).agg(F.min(number).alias(number))


def cdx_line() -> Column:
    """A line of an index of archive records, from their columns."""
    c = text.dash_if_none
    names = ("ip", "target_uri", "mimetype", "status", "digest", "offset", "length", "file")
    return F.concat_ws(" ", text.digits_date(F.col("date")), *(c(F.col(n)) for n in names))


def cdx_lines(records: DataFrame) -> DataFrame:
    return records.select(cdx_line().alias("value"))
