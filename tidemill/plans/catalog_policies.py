"""Queries of policies, preconditions, repair of URIs, links within pages and the rest of the scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text, uris
from tidemill.operators import extract, joins, policies, rules

from .base import FETCHES, fetches, query, surt_sql, table

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def _values(rows: list[tuple]) -> str:
    """Rows of literals for DuckDB."""
    literal = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


# ---- URIs

_REPAIRS = [
    ("http://archive.example:0080", "http://archive.example/"), ("http://a.example/x/../y/./z", "http://a.example/y/z"), ("http://a.example/../../f.html", "http://a.example/f.html"),
    ("http://a.example/aa/bb/cc/../../f.html", "http://a.example/aa/f.html"), ("http://a.example/aa/bb/..", "http://a.example/aa/"), ("http://a.example:80x/", None), ("http://a.example:70000/", None),
    ("HTTPS://WWW.Example.COM:443/A%20b", "https://www.example.com/A%20b"), ("http://a.example/café {x}?q={y}&r=é", "http://a.example/caf%C3%A9%20%7Bx%7D?q={y}&r=%C3%A9"),
    ("http://x_y..b.example/", None), ("http://a.example/i.html?  t=P", "http://a.example/i.html?%20%20t=P"), ("http://shoes.example%20%20", "http://shoes.example/"), ("http:////a.example\\b\\c#d", "http://a.example/b/c"),
    ("http://a.example/[^\"]|", "http://a.example/%5B%5E%22%5D|"), ("no scheme", None), ("http://a.example/th%way", "http://a.example/th%way"), ("http://a.example:8080//b//c", "http://a.example:8080//b//c"),
]


@query(f"select * from (values {_values(_REPAIRS)}) v(uri, repaired)")
def uri_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u, _ in _REPAIRS], "uri string").select("uri", uris.normalise(F.col("uri")).alias("repaired"))


_RELATIVE = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "g?y": "http://a/b/c/g?y", "g#s": "http://a/b/c/g", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../../g": "http://a/g", "/../../g": "http://a/g",
    "http://B.Example:80/X": "http://b.example/X", "ü?ü": "http://a/b/c/%C3%BC?%C3%BC", "http://räks.example/": "http://xn--rks-qla.example/",
}


@query(f"select * from (values {_values(list(_RELATIVE.items()))}) v(reference, uri)")
def uri_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r,) for r in _RELATIVE], "reference string")
    return rows.select("reference", uris.resolve(F.lit("http://a/b/c/d;p?q"), F.col("reference")).alias("uri"))


@query(f"""with h as (select page_id, {_HOST} as host, case when page_id % 3 = 0 then '10.0.' || (page_id % 200) || '.7' end as ip from pages),
    j as (select *, list_reduce(list_prepend(0::bigint, list_transform(string_split(coalesce(ip, host), ''), lambda c: ascii(c)::bigint)), lambda a, c: (a * 31 + c) & 4294967295) as u from h),
    n as (select *, abs(case when u >= 2147483648 then u - 4294967296 else u end) as h from j)
    select page_id, coalesce(ip, host) as by_ip, case when ip is null then 'NO-IP-' || (h & 1023) else (h % 1021)::varchar end as bucket from n""")
def class_keys_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10.0."), (F.col("page_id") % 200).cast("string"), F.lit(".7")))
    host = uris.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", uris.ip_class_key(host, ip).alias("by_ip"), uris.bucket_class_key(host, ip).alias("bucket"))


@query(f"with {FETCHES} select page_id, case when page_id % 4 = 0 or right(hops, 1) = 'P' then coalesce(via, uri) else uri end as basis, regexp_extract(regexp_extract(uri, '^[a-z]+://([^/?#]*)', 1), '([^.]+)$', 1) in ('com', 'net', 'org', 'example') as tld from fetches")
def policy_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = F.when(F.col("page_id") % 4 == 0, F.concat("hops", F.lit("P"))).otherwise(F.col("hops"))
    return fetches(spark, sf_dir).select("page_id", uris.policy_basis(F.col("uri"), F.col("via"), hop).alias("basis"), uris.is_tld(F.element_at(F.split("host", r"\."), -1)).alias("tld"))


# ---- links within pages

_PAGE = """<html><head><base href="http://b.example/d/"><!-- <base href="http://no.example/"> <a href="no.html"> -->
<meta http-equiv="refresh" content="5; url=next.html"><style>p { background: url(a.gif) }</style>
<script src="s.js">var u = "/x/y.html"; var t = '<a href="in-script.html">';</script></head><body onload="go('/z/load.html')">
<form method=post action="/post"><input value="/v/w.html"></form><form action="/get"></form><form METHOD="GET" action="/get2"></form>
<a href="j&#x41;va&eacute;.html">1</a><a href="p?a=1&amp;b=2">2</a><a href="javascript:open('/js/w.html')">3</a><a href="#top">4</a><a href="mailto:x@y">5</a>
<div style="background:url('i.png')"></div><img src="m.png" srcset="m1.png 1x, m2.png 2x"><param name=flashvars flashvars="f=http%3A%2F%2Ff.example%2Fm.xml&n=1"></body></html>"""
_LINKS = [
    ("http://b.example/d/next.html", "meta/@refresh", "R"), ("http://b.example/d/a.gif", "style", "E"), ("http://b.example/x/y.html", "script", "X"), ("http://b.example/d/in-script.html", "script", "X"), ("http://b.example/d/s.js", "script/@src", "E"), ("http://b.example/z/load.html", "handler", "X"),
    ("http://b.example/v/w.html", "@value", "X"), ("http://b.example/get", "form/@action", "L"), ("http://b.example/get2", "form/@action", "L"), ("http://b.example/d/jAva%C3%A9.html", "a/@href", "L"), ("http://b.example/d/p?a=1&b=2", "a/@href", "L"),
    ("http://b.example/js/w.html", "javascript:", "X"), ("http://b.example/d/i.png", "@style", "E"), ("http://b.example/d/m.png", "img/@src", "E"), ("http://b.example/d/m1.png", "@srcset", "E"), ("http://b.example/d/m2.png", "@srcset", "E"),
    ("http://f.example/m.xml", "@flashvars", "X"),
]


@query(f"select distinct url as src, v.* from pages, (values {_values(_LINKS)}) v(dst, context, hop)")
def html_inline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with everything that names links, in the place of each of the pages."""
    return extract.html_links(table(spark, sf_dir, "pages").select("url", F.lit(_PAGE).alias("html")))


@query("""with l as (select distinct url as src, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a\\s+href="([^"]+)"', 1)) as r from pages)
    select src, count(distinct replace(regexp_replace(r, '#.*$', ''), '&amp;', '&')) as links from l where r not like '#%' group by 1""")
def outlinks_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.html_links(table(spark, sf_dir, "pages"), resolve=False).filter("context = 'a/@href'")
    return links.select("src", F.regexp_replace("dst", "#.*$", "").alias("dst")).groupBy("src").agg(F.countDistinct("dst").alias("links"))


@query(f"""with {FETCHES} select page_id, mime, (coalesce(mime, '') = 'text/html' or ends_with(uri, '.html')) and bytes > 0 and status <> 404 as html, (coalesce(mime, '') = 'application/pdf' or ends_with(uri, '.pdf')) and bytes > 0 as pdf
    from (select *, case page_id % 3 when 0 then 'text/html' when 1 then 'application/pdf' end as mime from fetches)""")
def extractors_that_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("page_id") % 3 == 0, "text/html").when(F.col("page_id") % 3 == 1, "application/pdf")
    found = fetches(spark, sf_dir).withColumn("mime", mime)
    ask = lambda name, **kw: extract.applies(name, F.col("status"), F.col("mime"), F.col("uri"), F.col("bytes"), **kw).alias(name)
    return found.select("page_id", "mime", ask("html"), ask("pdf", missing_pages=True))


# ---- policies

_NAMES = ("mozilla anybot/1.0", "otherbot")
_GROUPS = [("anybot", ["/de/"], []), ("otherbot", ["/"], ["/en/"]), ("*", ["/en/7"], [])]
_PATH = "(select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p from pages)"


@query(f"""select page_id, not starts_with(p, '/de/') as obey, true as ignore, not starts_with(p, '/fr/') as custom, not starts_with(p, '/de/') as first_named, starts_with(p, '/en/') or not starts_with(p, '/en/7') as most_favoured from {_PATH}""")
def robots_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(*(F.struct(F.lit(a).alias("agent"), F.array(*map(F.lit, d)).cast("array<string>").alias("disallow"), F.array(*map(F.lit, w)).cast("array<string>").alias("allow")) for a, d, w in _GROUPS))
    pages = table(spark, sf_dir, "pages").select("page_id", uris.path(F.col("url")).alias("path"), groups.alias("groups"))
    names = {"most_favoured": ("otherbot", "thirdbot")}
    return pages.select("page_id", *(policies.robots_allowed(p, F.col("path"), F.col("groups"), names.get(p, _NAMES), (["/fr/"], [])).alias(p) for p in policies.POLICIES))


@query(f"""with {FETCHES}, h as (select host, min(page_id) as first from fetches group by 1), k as (select host, case when first % 2 = 0 then timestamp '2024-01-01 00:00:00' when first % 3 = 0 then timestamp '2024-01-01 11:00:00' end as t from h)
    select page_id, case when t is null or timestamp '2024-01-01 12:00:00' - t >= interval 6 hours then 'dns:' || host end as prerequisite from fetches join k using (host)""")
def dns_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fetches(spark, sf_dir)
    first = F.col("first")
    at = lambda t: F.lit(t).cast("timestamp")
    hosts = found.groupBy("host").agg(F.min("page_id").alias("first")).select("host", F.when(first % 2 == 0, at("2024-01-01 00:00:00")).when(first % 3 == 0, at("2024-01-01 11:00:00")).alias("ip_fetched"))
    return policies.dns_precondition(found, hosts, at("2024-01-01 12:00:00")).select("page_id", "prerequisite")


_CREDENTIALS = [("example.com", "http://example.com/login"), ("www.example.com", "http://www.example.com/in"), ("example.net", "http://example.net/login")]


@query(f"""with c(domain, login_uri) as (values {_values(_CREDENTIALS)}), h as (select page_id, {_HOST} as host from pages), b as (select page_id, arg_max(login_uri, length(domain)) as l from h join c on host = domain or ends_with(host, '.' || domain) group by 1)
    select page_id, case when l <> 'http://example.net/login' then l end as prerequisite from h left join b using (page_id)""")
def credential_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The login that each page's host asks for first; that of one domain was done."""
    credentials = spark.createDataFrame(_CREDENTIALS, "domain string, login_uri string")
    done = spark.createDataFrame([("http://example.net/login",)], "uri string")
    return policies.credential_precondition(fetches(spark, sf_dir), credentials, done).select("page_id", "prerequisite")


@query(f"select gone, count(*) as n from (select contains({_HOST}, 'example.org') and regexp_matches(url, '^https?://[^/]*/de/.*$') as gone from pages) group by 1")
def deleted_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "pages").select(F.col("url").alias("uri"), uris.class_key(F.col("url")).alias("class_key"))
    stays, goes = policies.delete_pending(pending, "org,example,.*", r"https?://[^/]*/de/.*")
    counted = lambda df, gone: df.groupBy(F.lit(gone).alias("gone")).agg(F.count("*").alias("n"))
    return counted(stays, False).union(counted(goes, True))


_TAGS = ("F+", "Fe", "Fs", "Ff", "Fd", "Fr")


@query("""with e as (select user_id * 100 + event_id % 37 as uri, ['F+', 'Fe', 'Fs', 'Ff', 'Fd', 'Fr'][(event_id % 6) + 1] as tag from events), u as (select uri, bool_or(tag = 'F+') as a, bool_or(tag = 'Fs') as s, bool_or(tag = 'Ff') as f, bool_or(tag = 'Fd') as d, bool_or(tag = 'Fr') as r from e group by 1)
    select count(*) filter (a) as discovered, count(*) filter (a and not (s or f or d) and not r) as queued, count(*) filter (s or f or d) as finished, count(*) filter (s) as succeeded, count(*) filter (f) as failed, count(*) filter (d) as disregarded, count(*) filter (r and not (s or f or d)) as future from u""")
def frontier_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("event_id") % 6 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 37).alias("uri"), tag.alias("tag"))
    return policies.frontier_counts(events)


@query("""with h as (select distinct url from pages) select 'html' as extractor, count(*) as pages, count(*) * 11 as links from h union all select 'script', count(*), count(*) * 4 from h union all select 'css', count(*), count(*) * 2 from h""")
def extractor_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.links_by_extractor(html_inline_links(spark, sf_dir))


@query("""with recursive t as (select conv_id * 1000 + turn as uri, case when turn > 0 then conv_id * 1000 + turn - 1 end as via from conversations),
    s as (select uri, uri as seed, 0 as depth from t where via is null union all select t.uri, s.seed, s.depth + 1 from t join s on t.via = s.uri) select seed, count(*) as n, string_agg(uri::varchar, ',' order by uri::varchar) as uris from s where depth > 0 group by 1""")
def discovered_per_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uri"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("via"))
    return policies.discovered_per_seed(joins.paths_to_seeds(turns))


@query(f"select count(distinct {surt_sql('url')}) as seen, round(avg(length({surt_sql('url')})), 6) as mean_entry, max(length({surt_sql('url')}))::int as longest_entry from pages")
def seen_and_entry_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "pages").select(uris.surt(F.col("url")).alias("k"))
    return keys.agg(F.countDistinct("k").alias("seen"), F.round(F.avg(F.length("k")), 6).alias("mean_entry"), F.max(F.length("k")).alias("longest_entry"))


@query("""with q as (select user_id, max((ts, (value * 10)::bigint)) as l from events group by 1) select user_id, l[1] + to_milliseconds(l[2] * 1000) > timestamp '2024-01-20' as snoozed from q""".replace("l[1]", "l.a").replace("l[2]", "l.b").replace("max((ts, (value * 10)::bigint))", "max({'a': ts, 'b': floor(value * 10)::bigint})"))
def snoozed_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", (F.floor(F.col("value") * 10).cast("long") * 1000).alias("wait"))
    return policies.snooze(events, "user_id", "ts", "wait", F.lit("2024-01-20").cast("timestamp")).select("user_id", "snoozed")


@query(f"""with {FETCHES}, w as (select page_id, host, page_id % 4 = 0 as enqueued, 1 + page_id % 3 as cost from fetches), s as (select *, sum(case when enqueued then 0 else cost end) over (partition by host order by page_id rows unbounded preceding) as n from w)
    select page_id, not enqueued and starts_with(host, 'www') and 5 + 10 + n > 40 as over_budget from s""")
def candidates_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fetches(spark, sf_dir).select("page_id", F.col("host").alias("class_key"), (F.col("page_id") % 4 == 0).alias("enqueued"), (F.col("page_id") % 3 + 1).alias("cost"))
    total = F.when(F.col("class_key").startswith("www"), 40).otherwise(-1)
    queues = found.select("class_key").distinct().select("class_key", F.lit(5).alias("pending"), F.lit(10).alias("spent"), total.alias("total"))
    return policies.over_budget(found, queues, ["page_id"]).select("page_id", "over_budget")


@query(f"""with {FETCHES} select page_id, host like '%example.org' or coalesce(regexp_extract(via, '^[a-z]+://([^/?#]*)', 1) like '%example.org', false) as plus_one, regexp_matches(uri, '^https.*') or regexp_matches(uri, '.*/de/.*') as any_filter,
    case when page_id % 3 = 0 then true when page_id % 3 = 1 then false end as revisit, page_id % 2 = 0 and page_id % 5 > 0 as arc from fetches""")
def older_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop beyond the scope, any of several filters, marks for revisits, what goes into the older archive format."""
    found = fetches(spark, sf_dir)
    marked = policies.revisit_flag(found, F.when(F.col("page_id") % 3 == 0, rules.ACCEPT).when(F.col("page_id") % 3 == 1, rules.REJECT))
    inside = lambda host: host.endswith("example.org")
    kind, mime = F.when(F.col("page_id") % 2 == 0, "response").otherwise("request"), F.when(F.col("page_id") % 5 == 0, "application/warc-fields").otherwise("text/html")
    return marked.select("page_id", policies.scope_plus_one(inside(F.col("host")), inside(uris.host(F.col("via")))).alias("plus_one"), rules.matches_list(F.col("uri"), ["https.*", ".*/de/.*"]).alias("any_filter"), "revisit", policies.arc_content(kind, mime).alias("arc"))


# ---- scalars


@query("""select event_id, event_id as again, 'a b' || event_id || '%zz' as decoded, rtrim(rtrim(printf('%.3f', event_id / 8.0), '0'), '.') as shown, event_id * 7919 as number from events""")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    coded = text.base32(F.encode(e.cast("string"), "utf-8"))
    again = F.decode(text.from_base32(F.lower(coded)), "utf-8").cast("long")
    loose = text.decode_loosely(F.concat(F.lit("a+b"), e.cast("string"), F.lit("%zz")))
    return table(spark, sf_dir, "events").select("event_id", again.alias("again"), loose.alias("decoded"), text.decimal(e / 8, 3).alias("shown"), text.bytes_long(text.long_bytes(e * 7919)).alias("number"))


@query("select o_orderkey, date_trunc('day', o_orderdate)::timestamp + interval 1 hour as at, 1994 as year from orders")
def http_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("Sun, "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" 01:00:00 GMT"))
    late = F.year(text.http_date(F.lit("Sunday, 06-Nov-2094 08:49:37 GMT")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.http_date(header).alias("at"), late.alias("year"))
