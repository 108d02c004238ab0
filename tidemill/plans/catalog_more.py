"""Queries without SQL (archives, streams, state) and those of the older generations' operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import canonical, hops, text, uris
from tidemill.operators import extract, frontier, joins, rules, stats
from tidemill.operators.scratch import shared_folder, staged
from tidemill.sources import archives
from tidemill.streaming import crawl

from .base import FETCHES, fetches, query, table


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place that the cluster shares; archives are written through folders mounted alike."""
    return f"{shared_folder(spark).removeprefix('file://')}/tidemill-{name}-{uuid.uuid4().hex}"


# ---- archives


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """pages written as an archive and read again."""
    archives.register(spark)
    path = _folder(spark, kind)
    rows = table(spark, sf_dir, "pages").select(F.lit("response").alias("type"), F.col("url").alias("target_uri"), F.timestamp_seconds(1704067200 + F.col("page_id")).alias("date"), F.lit("text/html").alias("mimetype"), F.lit("192.0.2.1").alias("ip"), F.encode("html", "utf-8").alias("payload"))
    rows.write.format("webarchive").option("archive", kind).mode("append").save(path)
    return spark.read.format("webarchive").load(path).filter("type = 'response'")


_ARCHIVE = "select url as target_uri, 'text/html' as mimetype, '192.0.2.1' as ip, strlen(html)::bigint as length, sha1(html) as digest, make_timestamp(1704067200000000 + page_id * 1000000) as date from pages"


@query(_ARCHIVE)
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "warc").select("target_uri", "mimetype", "ip", "length", F.sha1("payload").alias("digest"), "date")


@query(_ARCHIVE)
def arc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "arc").select("target_uri", "mimetype", "ip", "length", F.sha1("payload").alias("digest"), "date")


@query("select count(*) as records, count(distinct url) as uris from pages")
def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an archive's records, each read again at its offset: all come back as they were."""
    found = _round_trip(spark, sf_dir, "warc").select("file", "offset", "target_uri", F.sha1("payload").alias("digest"))

    def again(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            found_uris, same = [], []
            for file, offset, digest in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "digest"))):
                [record] = list(archives.read_file(file, offset=offset, only=True))
                found_uris.append(record[6])
                same.append(hashlib.sha1(record[10]).hexdigest() == digest)
            yield pa.RecordBatch.from_arrays([pa.array(found_uris, pa.string()), pa.array(same, pa.bool_())], names=["uri", "same"])

    read = found.mapInArrow(again, "uri string, same boolean")
    return read.filter("same").agg(F.count("*").alias("records"), F.countDistinct("uri").alias("uris"))


# ---- streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if os.path.isfile(path):  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", "events.parquet"), sf_dir
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until its source is read through.

    Rows that are appended go to files of the shared folder, as they may be as many as the source's; a complete result
    is a table in memory of the driver: for small ones.
    """
    spark, name = stream.sparkSession, f"t{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        writer.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    path = f"{shared_folder(spark)}/tidemill-scratch/stream-{name}"
    writer.format("parquet").option("checkpointLocation", f"{path}-state").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("select time_bucket(interval '1 day', ts) as start, time_bucket(interval '1 day', ts) + interval '1 day' as \"end\", count(*) as n, count(*) filter (event_type = 'error') as errors from events group by 1, 2")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = crawl.sampled(_stream(spark, sf_dir), "ts", "1 day", "1 hour", [F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")])
    return _drained(counted, "complete")


@query("select user_id, count(*) as n from (select distinct user_id, event_type from events) group by 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = crawl.unseen(_stream(spark, sf_dir).select(F.concat_ws("/", "user_id", "event_type").alias("k"), "user_id"), "k")
    return _drained(seen, "append").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '1 day' then 0 else 1 end as o from events), s as (select user_id, ts, sum(o) over (partition by user_id order by ts) as k from g)
    select user_id, min(ts) as start, max(ts) + interval '1 day' as "end", count(*) as n from s group by user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "1 day", "1 hour")


@query()
def stateful_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("class_key"), F.col("event_id").cast("string").alias("uri"), F.floor("value").cast("int").alias("cost"), F.col("event_id").alias("ordinal"))
    return _drained(crawl.frontier(candidates, session=200, total=1500), "append")


@query()
def batch_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    candidates = events.select(F.col("user_id").cast("string").alias("class_key"), F.col("event_id").cast("string").alias("uri"), F.floor("value").cast("int").alias("cost"), F.col("event_id").alias("ordinal"))
    return crawl.frontier_batch(candidates, session=200, total=1500)


@query("select strftime(ts, '%Y%m%d%H') as generation, count(*) as n from events group by 1")
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(crawl.generation(F.col("ts")).alias("generation")).agg(F.count("*").alias("n"))


# ---- frontier and crawl rounds


@query(f"""with {FETCHES} select page_id, case when right(hops, 1) = 'R' then case when contains(hops, 'L') then 2 else 1 end when length(regexp_extract(hops, '[^L]*$')) = 1 then 2 else 3 end as scheduling,
    least(1 + length(hops) - length(replace(hops, 'L', '')), 127)::int as precedence from fetches""")
def frontier_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.prepare(fetches(spark, sf_dir)).select("page_id", "scheduling", "precedence")


@query("""with h as (select url as src, page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a\\s+href="[^"]+"')) as h from pages), l as (select distinct src, page_id, replace(regexp_extract(h, '"(.*)"', 1), '&amp;', '&') as dst from h)
    select distinct dst as uri, src as via, ['', 'L', 'LL', 'LLE', 'LER', 'LEEX', 'LLLLP'][(page_id % 7) + 1] || 'L' as hops from l where page_id % 10 in (1, 2, 6, 7, 8, 9)""")
def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.html_links(table(spark, sf_dir, "pages"), resolve=False, keys=["page_id"]).filter("context = 'a/@href'")
    found = fetches(spark, sf_dir).withColumns({"source_tag": F.lit(None).cast("string"), "is_seed": F.col("hops") == ""})
    return extract.candidates(links, found, keys=["page_id"]).select("uri", "via", "hops").distinct()


@query()
def crawl_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of a crawl over the pages as a web: seeds, scope, dedup by canonical form, links of what was found."""
    pages = table(spark, sf_dir, "pages").withColumn("uri", uris.normalise(F.col("url")))
    # each round reads links and what was found so far
    links = staged(extract.html_links(pages.select("uri", "html"), url="uri").select("src", "dst", "hop").distinct(), "links")
    found = pages.filter("page_id % 10 = 0").select("uri", F.lit("").alias("hops"))
    for last in (False, True):
        more = links.join(found.withColumnRenamed("uri", "src"), "src").select(F.col("dst").alias("uri"), F.concat("hops", "hop").alias("hops"))
        more = more.filter(~rules.too_many_hops(F.col("hops"), 3) & ~rules.scheme_not_in(F.col("uri")))
        both = found.unionByName(more).withColumn("canonical", canonical.canonical(F.col("uri")))
        found = both.groupBy("canonical").agg(F.min_by(F.struct("uri", "hops"), F.struct(F.length("hops"), "hops", "uri")).alias("r")).select("r.*")
        found = found if last else staged(found, "found")
    return found


# ---- older generations


@query(f"""with {FETCHES}, t as (select page_id, uri, length(hops) - length(replace(hops, 'L', '')) as l, length(regexp_extract(hops, '[^L]*$')) as e from fetches)
    select page_id, (page_id % 9 = 0 or uri like '%example.org%' or (e > 0 and e <= 5)) and not (uri like '%/de/%' or l > 3) as in_scope from t""")
def classic_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("uri")
    focus, exclude = u.contains("example.org"), u.contains("/de/")
    return fetches(spark, sf_dir).select("page_id", rules.scope(F.col("page_id") % 9 == 0, focus, exclude, F.col("hops"), most_links=3).alias("in_scope"))


@query(f"with {FETCHES}, r as (select page_id, row_number() over (partition by host order by page_id) as k from fetches) select page_id from r where k <= 2")
def documents_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.limit_per_key(fetches(spark, sf_dir), "host", ["page_id"], 2).select("page_id")


@query("""select event_id, case when coalesce(m, e) is null then null when m is not null and e is not null then m and e else coalesce(m, e) end as unchanged from
    (select event_id, case when event_id % 3 > 0 then user_id % 2 = 0 end as m, case when event_id % 4 > 0 then user_id % 5 = 0 end as e from events)""")
def midfetch_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    has_date, has_tag = F.col("event_id") % 3 > 0, F.col("event_id") % 4 > 0
    now = F.when(has_date, F.col("user_id") % 2), F.when(has_tag, F.col("user_id") % 5)
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "events").select("event_id", rules.unchanged(now[0], zero, now[1], zero).alias("unchanged"))


@query(f"with {FETCHES}, t as (select page_id, regexp_extract(hops, '[^L]*$') as t from fetches) select page_id, length(t) > 0 and length(t) - length(replace(t, 'X', '')) <= 1 and length(t) - length(replace(t, 'E', '')) <= 1 and length(t) <= 2 as part from t")
def transclusion_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches(spark, sf_dir).select("page_id", hops.transcluded_by_kind(F.col("hops"), embed=1).alias("part"))


@query(f"with {FETCHES}, c as (select page_id, uri, host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as d, via, regexp_extract(regexp_extract(via, '^[a-z]+://([^/?#]*)', 1), '([^.]+\\.[^.]+)$', 1) as v from fetches) select page_id, coalesce(d <> v, false) as leaves from c")
def domain_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches(spark, sf_dir).select("page_id", rules.leaves_domain(F.col("uri"), F.col("via")).alias("leaves"))


_HOST_SETTINGS = [("example.com", "5"), ("example.net", "7"), ("www.example.net", "8")]


@query(f"""with s(domain, delay) as (values {", ".join(map(str, _HOST_SETTINGS))}), {FETCHES}
    select page_id, coalesce(arg_max(delay, length(domain)), '3') as delay from fetches left join s on host = domain or ends_with(host, '.' || domain) group by page_id""")
def host_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings inherited from the host's nearest domain that has any."""
    settings = spark.createDataFrame(_HOST_SETTINGS, "domain string, delay string")
    rows = fetches(spark, sf_dir).select("page_id", F.explode(joins.suffix_ladder(F.col("host"))).alias("domain"))
    best = rows.join(settings, "domain", "left").groupBy("page_id").agg(F.max_by("delay", F.when(F.col("delay").isNotNull(), F.length("domain"))).alias("delay"))
    return best.select("page_id", F.coalesce("delay", F.lit("3")).alias("delay"))


@query("select p_brand, p_type, count(*) as n from part where p_size between 10 and 20 group by 1, 2 intersect select p_brand, p_type, count(*) as n from part where p_size between 10 and 20 and p_partkey > 0 group by 1, 2")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").filter("p_size between 10 and 20")
    grouped = lambda rows: rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return grouped(part).intersect(grouped(part.filter("p_partkey > 0")))


@query("select n_name, r_name, count(*) as customers, sum(round(o_totalprice))::bigint as spent from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on o_custkey = c_custkey where o_orderdate >= timestamp '1995-01-01' group by 1, 2")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = t("orders").filter("o_orderdate >= timestamp '1995-01-01'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum(F.round("o_totalprice").cast("long")).alias("spent"))


@query("select l_returnflag, l_linestatus, sum(l_quantity)::bigint as quantity, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"))


@query("select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as next_turn, count(*) over (partition by conv_id) as turns from conversations")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(w.orderBy("turn")).alias("next_turn"), F.count("*").over(w).alias("turns"))


@query("select event_id, value from events where event_id > 500 and regexp_matches(event_type, '^(view|click)$') order by event_id limit 50")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of what is pending, after a mark."""
    rows = table(spark, sf_dir, "events").filter("event_id > 500").filter(rules.full(F.col("event_type"), "view|click"))
    return rows.orderBy("event_id").limit(50).select("event_id", "value")


@query("select label, count(*) as n, round(avg(list_sum(embedding::double[])), 3) as total from embeddings group by 1")
def vector_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(total), 3).alias("total"))


@query("select source, count(*) as n, count(*) filter (quality = 1) as good from documents join labels using (doc_id) group by 1")
def labelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))


@query("select s_name, count(*) as n from supplier join lineitem on l_suppkey = s_suppkey group by 1 having count(*) > 500")
def busy_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stats.histogram(table(spark, sf_dir, "lineitem"), "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    return counted.filter("n > 500").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "n")


@query("select page_id, case when length(html) < 1024 then length(html) || ' B' when length(html) < 10240 then printf('%.1f KiB', length(html) / 1024.0) when length(html) < 1048576 then printf('%.0f KiB', length(html) / 1024.0) when length(html) < 10485760 then printf('%.1f MiB', length(html) / 1048576.0) else printf('%.0f MiB', length(html) / 1048576.0) end as size from pages")
def display_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.display_bytes(F.length("html")).alias("size"))
