"""Queries over pages: canonical forms, parts, sort keys, hops, costs, scope rules, extraction, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import canonical, hops, robots, text, uris
from tidemill.operators import extract, joins, rules, stats

from .base import FETCHES, fetches, query, surt_sql, table

_MANGLED = "url || case page_id % 6 when 0 then '?' when 1 then '?&' when 2 then '?&x=y' when 3 then '&' when 4 then '?jsessionid=0123456789abcdef0123456789ABCDEF&z=1' else '' end"


def _mangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and URLs with user names, capitals and session ids put in."""
    pages = table(spark, sf_dir, "pages")
    end = F.element_at(F.array(*map(F.lit, ("?", "?&", "?&x=y", "&", "?jsessionid=0123456789abcdef0123456789ABCDEF&z=1", ""))), (F.pmod("page_id", F.lit(6)) + 1).cast("int"))
    return pages.select("page_id", F.concat("url", end).alias("url"))


_FIXUP = """case when instr(u, '?') < 2 then u
    when right(u, 1) = '?' then u[:-2] when regexp_matches(u, '\\?&$') then u[:-3]
    when regexp_matches(u, '\\?&[^?]*$') then regexp_replace(u, '\\?&([^?]*)$', '?\\1')
    when right(u, 1) = '&' then u[:-2] else u end""".replace("\\\\", "\\")


@query(f"with m as (select page_id, {_MANGLED} as u from pages) select page_id, {_FIXUP} as fixed from m")
def canon_fixup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mangled(spark, sf_dir).select("page_id", canonical.fixup_query(F.col("url")).alias("fixed"))


_CANON = f"""with m as (select page_id, lower(regexp_replace({_MANGLED}, '://', '://me:pw@')) as u from pages),
a as (select page_id, regexp_replace(u, '^((http|ftp)s?://)[^/]+@', '\\1') as u from m),
b as (select page_id, regexp_replace(u, '^(https?://)www[0-9]*\\.([^/]*/.)', '\\1\\2') as u from a),
c as (select page_id, regexp_replace(u, '^(.+)(jsession|phpsess)id=[0-9a-z]{{32}}(&|$)', '\\1') as u from b)
select page_id, {_FIXUP} as canonical from c"""


@query(_CANON)
def canon_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _mangled(spark, sf_dir).withColumn("url", F.replace("url", F.lit("://"), F.lit("://me:pw@")))
    return named.select("page_id", canonical.canonical(F.col("url")).alias("canonical"))


@query("""select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as query, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www[0-9]*\\.', '') as basename,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || case when url like 'https:%' then ':443' else '' end as server_key,
    string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[-1] as filename from pages""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    columns = {"scheme": uris.scheme(u), "host": uris.host(u), "path": uris.path(u), "query": uris.query(u), "basename": uris.host_basename(u), "server_key": uris.server_key(u), "filename": uris.filename(u)}
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in columns.items()))


@query("select page_id, regexp_replace(url, '#.*$', '') as uri from pages")
def uri_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("  "), F.replace(F.replace("url", F.lit("://"), F.lit(":////")), F.lit(".example"), F.lit(".\tEXAMPLE")), F.lit("\n"))
    return table(spark, sf_dir, "pages").select("page_id", uris.normalise(odd).alias("uri"))


@query(f"select page_id, {surt_sql('url')} as surt from pages")
def surt_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uris.surt(F.col("url")).alias("surt"))


@query(f"""with s as (select page_id, {surt_sql("regexp_replace(url, '^https://', 'http://')")} as s from pages)
    select page_id, regexp_replace(s, '^([a-z]+://[^/]*/)([^/]*/)*[^/]*$', regexp_extract(s, '^([a-z]+://.*/)', 1)) as prefix from s""")
def surt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uris.surt_prefix(F.col("url")).alias("prefix"))


@query("""with h as (select page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.') as l from pages) select l[-2] || '.' || l[-1] as domain, count(*) as n from h group by 1""")
def assigned_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(uris.assigned_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("""select array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')), ',') || ',' as class_key, count(*) as n from pages group by 1""")
def class_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "pages").withColumn("class_key", uris.class_key(F.col("url"))), "class_key")


@query(f"""with {FETCHES} select page_id, length(hops)::int as hop_count, length(regexp_extract(hops, '[^L]*$'))::int as embed_hops, (length(hops) - length(replace(hops, 'L', '')))::int as link_hops,
    right(hops, 1) = 'R' as redirect, length(hops) > 3 as far from fetches""")
def hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("hops")
    return fetches(spark, sf_dir).select("page_id", hops.hop_count(h).alias("hop_count"), hops.embed_hops(h).alias("embed_hops"), hops.link_hops(h).alias("link_hops"), hops.is_redirect(h).alias("redirect"), rules.too_many_hops(h, 3).alias("far"))


@query("""select n, case when n > 50 then (n - 50)::varchar || '+' || repeat('L', 50) else repeat('L', n::int) end as hops, n as hop_count from range(0, 60) t(n)""")
def hop_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(60).select(F.col("id").alias("n"))
    step = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(""), lambda path, _: hops.extend(path, F.lit("L")))
    path = F.when(F.col("n") > 0, step).otherwise("")
    return rows.select("n", path.alias("hops"), hops.hop_count(path).cast("long").alias("hop_count"))


@query(f"""with {FETCHES}, t as (select page_id, regexp_extract(hops, '[^L]*$') as t from fetches)
    select page_id, length(t) > 0 and length(t) - length(replace(t, 'X', '')) <= 1 and length(replace(t, 'R', '')) <= 2 as transcluded from t""")
def transclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches(spark, sf_dir).select("page_id", hops.transcluded(F.col("hops")).alias("transcluded"))


@query(f"""with {FETCHES} select page_id, (1 + (contains(uri, '?'))::int + (contains(uri, '?') and starts_with(coalesce(via, ''), string_split(uri, '?')[1]))::int) as wag,
    1 + (regexp_matches(uri, '(?i)calendar|calendrier|event|year|month|day|date|jour|viewcal|yr=') or regexp_matches(uri, '[^0-9](19|20)[0-9][0-9][^0-9]'))::int as calendar from fetches""")
def cost_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches(spark, sf_dir).select("page_id", hops.cost_by_query(F.col("uri"), F.col("via")).alias("wag"), hops.cost_by_calendar(F.col("uri")).alias("calendar"))


@query("""select event_id, greatest(least(greatest((value * 100 * 5)::bigint, 3000), 30000), (least((event_id % 40)::double, 300) * 1000)::bigint) as delay
    from (select event_id, floor(value) as value from events)""")
def politeness_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", hops.politeness_delay(F.floor("value") * 100, F.pmod("event_id", F.lit(40)).cast("double")).alias("delay"))


@query("""select user_id, (3 + (n >= 20)::int + floor(greatest(n - 20, 0) / 30.0))::int as precedence from (select user_id, count(*) filter (event_type <> 'error') as n from events group by 1)""")
def queue_precedence_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("n"))
    return n.select("user_id", hops.precedence_by_success(F.col("n"), 3, (20, 30)).alias("precedence"))


@query(f"""with {FETCHES} select page_id, case when status in (-50, -1, -2, -3, 0) then 'retry' when status > 0 then 'success' when status in (-9998, -5003, -5002, -5001, -5000, -5004, -6000) then 'disregard' else 'failure' end as outcome,
    case when status in (-1, -2, -3) then 900 else 0 end as retry_delay, case status when -9998 then 'robots excluded' when -2 then 'connect failure' when -5003 then 'blocked by quota' else 'HTTP ' || status end as label from fetches""")
def status_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return fetches(spark, sf_dir).select("page_id", hops.outcome(s, F.lit(1)).alias("outcome"), hops.retry_delay(s).alias("retry_delay"), hops.status_label(s).alias("label"))


# ---- scope

_RULES = r"""with {f}, d as (select page_id, [null,
    'REJECT',
    case when regexp_matches(uri, '^https?://(www\.|blog\.).*$') then 'ACCEPT' end,
    case when length(hops) > 3 then 'REJECT' end,
    case when regexp_matches(uri, '(?i)\.(gif|pdf)$') then 'REJECT' end,
    case when length(uri) - length(replace(uri, '/', '')) > 4 then 'REJECT' end,
    case when regexp_extract(hops, '[^L]*$') <> '' and page_id % 7 in (3, 4, 6) then 'ACCEPT' end,
    case when uri like '%spam%' then 'REJECT' end] as r from fetches)
select page_id, coalesce(r[8], r[7], r[6], r[5], r[4], r[3], r[2], r[1]) as decision from d"""


@query(_RULES.replace("{f}", FETCHES))
def scope_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, h = F.col("uri"), F.col("hops")
    sequence = [
        rules.rule(F.lit(False)), rules.reject(), rules.rule(rules.full(u, r"https?://(?:www\.|blog\.).*")), rules.rule(rules.too_many_hops(h, 3), rules.REJECT),
        rules.rule(F.regexp_like(u, F.lit(r"(?i)\.(?:gif|pdf)$")), rules.REJECT), rules.rule(rules.too_many_segments(u, 4), rules.REJECT), rules.rule(hops.transcluded(h)), rules.rule(rules.full(u, ".*spam.*"), rules.REJECT),
    ]
    return fetches(spark, sf_dir).select("page_id", rules.last_word(sequence).alias("decision"))


@query("""select page_id, regexp_matches(url || f, '(?i)\\.(bmp|gif|jpg|jpeg|png|svg|tif|tiff)$') as image, regexp_matches(url || f, '(?i)\\.(pdf|doc|xls|ppt|css|js|smil|zip|gz|tgz|rar|exe)$') as misc
    from (select *, ['', '.GIF', '.pdf', '.css?x'][(page_id % 4) + 1] as f from pages)""")
def file_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("url", F.element_at(F.array(*map(F.lit, ("", ".GIF", ".pdf", ".css?x"))), (F.pmod("page_id", F.lit(4)) + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", rules.has_suffix(name, "images").alias("image"), rules.has_suffix(name, "misc").alias("misc"))


@query("""select page_id, page_id % 4 = 3 as trap from pages""")
def pathological_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.concat("url", F.lit("/"), F.repeat(F.lit("again/"), F.pmod("page_id", F.lit(4)).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", rules.repeats_segment(deep).alias("trap"))


@query(f"""with {FETCHES} select page_id, case when not regexp_matches(uri, '^https.*$') then -5001 when regexp_matches(uri, '^.*/de/.*$') then -5001 when length(hops) > 4 then -5000 end as stopped from fetches""")
def preselector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.when(F.length("hops") <= 4, rules.ACCEPT).otherwise(rules.REJECT)
    return fetches(spark, sf_dir).select("page_id", rules.preselect(F.col("uri"), allow="https.*", block=".*/de/.*", recheck=near).alias("stopped"))


_SEEDS = "seeds as (select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages where page_id % 25 = 0)"


def _seed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("page_id % 25 = 0").select(uris.host(F.col("url")).alias("host")).distinct()


@query(f"with {_SEEDS} select page_id from pages where regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) in (select host from seeds)")
def scope_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", uris.host(F.col("url")).alias("host"))
    return pages.join(_seed_hosts(spark, sf_dir), "host", "left_semi").select("page_id")


@query(f"with {_SEEDS}, b as (select distinct regexp_replace(host, '^(www|blog|m)\\.', '') as d from seeds), h as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as h from pages) select page_id from h where exists (select 1 from b where h = d or ends_with(h, '.' || d))")
def scope_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = _seed_hosts(spark, sf_dir).select(F.regexp_replace("host", r"^(www|blog|m)\.", "").alias("domain"))
    pages = table(spark, sf_dir, "pages").select("page_id", uris.host(F.col("url")).alias("host"))
    return joins.domain_semi(pages, "host", domains).select("page_id")


_PREFIXES = f"p as (select distinct regexp_extract(s, '^([a-z]+://\\([^)]*\\)/[a-z]+/)', 1) as prefix from (select {surt_sql('url')} as s from pages where page_id % 25 = 0)), k as (select page_id, {surt_sql('url')} as s from pages)"


def _prefixes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = table(spark, sf_dir, "pages").select("page_id", uris.surt(F.col("url")).alias("surt"))
    prefixes = keys.filter("page_id % 25 = 0").select(F.regexp_extract("surt", r"^([a-z]+://\([^)]*\)/[a-z]+/)", 1).alias("prefix")).distinct()
    return keys, prefixes


@query(f"with {_PREFIXES} select page_id from k where exists (select 1 from p where starts_with(s, prefix))")
def prefix_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, prefixes = _prefixes(spark, sf_dir)
    return joins.prefix_semi(keys, "surt", prefixes).select("page_id")


@query(f"with {_PREFIXES} select page_id from k where not exists (select 1 from p where starts_with(s, prefix))")
def prefix_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, prefixes = _prefixes(spark, sf_dir)
    return joins.prefix_semi(keys, "surt", prefixes, anti=True).select("page_id")


_LADDER = f"""p as (select distinct unnest([s, regexp_extract(s, '^([a-z]+://\\([a-z]+,)', 1), regexp_extract(s, '^([a-z]+://\\([a-z]+,[a-z]+,)', 1)]) as prefix from (select regexp_extract({surt_sql('url')}, '^([a-z]+://\\([^)]*\\))', 1) as s from pages where page_id % 10 = 0)),
    k as (select page_id, {surt_sql('url')} as s from pages)"""


def _ladder(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = table(spark, sf_dir, "pages").select("page_id", uris.surt(F.col("url")).alias("surt"))
    part = [F.regexp_extract("surt", p, 1) for p in (r"^([a-z]+://\([^)]*\))", r"^([a-z]+://\([a-z]+,)", r"^([a-z]+://\([a-z]+,[a-z]+,)")]
    return keys, keys.filter("page_id % 10 = 0").select(F.explode(F.array(*part)).alias("prefix")).distinct()


@query(f"with {_LADDER} select page_id, prefix from k join p on starts_with(s, prefix)")
def prefix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, prefixes = _ladder(spark, sf_dir)
    return joins.all_prefixes(keys, "surt", prefixes).select("page_id", "prefix")


@query(f"with {_LADDER} select page_id, arg_max(prefix, length(prefix)) as prefix from k left join p on starts_with(s, prefix) group by page_id")
def prefix_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, prefixes = _ladder(spark, sf_dir)
    return joins.longest_prefix(keys, "surt", prefixes).select("page_id", "prefix")


@query(f"with {_LADDER} select prefix from p where not exists (select 1 from p q where q.prefix <> p.prefix and starts_with(p.prefix, q.prefix))")
def prefix_minimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.minimise_prefixes(_ladder(spark, sf_dir)[1])


_MARKS = "marks(boundary, target) as (values ('com,example,th', 'one'), ('net,example,m', 'two'), ('org,example,b', 'three'))"
_KEY = "array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.')), ',') || ','"


@query(f"with {_MARKS} select page_id, coalesce((select target from marks where boundary >= {_KEY} order by boundary limit 1), 'one') as target from pages")
def ceiling_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([("com,example,th", "one"), ("net,example,m", "two"), ("org,example,b", "three")], "boundary string, target string")
    keys = table(spark, sf_dir, "pages").select("page_id", uris.class_key(F.col("url")).alias("class_key"))
    return joins.next_key(keys, "class_key", marks, "boundary", "target").select("page_id", "target")


@query(f"with {_MARKS}, m as (select coalesce((select target from marks where boundary >= {_KEY} order by boundary limit 1), 'one') as target from pages) select target, count(*) as n from m group by 1")
def range_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ceiling_map(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"))


_OVERLAYS = [("http", 0, "precedence", "10"), ("http", 0, "delay", "5"), ("https://(com,", 1, "precedence", "5"), ("https://(com,example,", 2, "delay", "1"), ("https://(org,", 1, "precedence", "1")]


@query(f"""with o(prefix, ord, key, value) as (values {", ".join(map(str, _OVERLAYS))}), k as (select page_id, {surt_sql('url')} as s from pages)
    select page_id, coalesce(arg_max(value, ord) filter (key = 'precedence'), '3') as precedence, coalesce(arg_max(value, ord) filter (key = 'delay'), '9') as delay, '7' as budget from k left join o on starts_with(s, prefix) group by page_id""")
def overlay_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlays = spark.createDataFrame(_OVERLAYS, "prefix string, ord int, key string, value string")
    keys = table(spark, sf_dir, "pages").select("page_id", uris.surt(F.col("url")).alias("surt"))
    return joins.overlay(keys, "page_id", "surt", overlays, {"precedence": 3, "delay": 9, "budget": 7}).drop("surt")


_ROBOTS = "User-agent: *\nDisallow: /de/\nDisallow: /en/7\nAllow: /en/\nCrawl-delay: 4\n\nUser-agent: otherbot\nUser-agent: denybot\nDisallow: /\n"
_RULE_SQL = """with r(p, kind) as (values ('/de/', 'd'), ('/en/7', 'd'), ('/en/', 'a')), x as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, coalesce((select max(length(p)) from r where kind = 'd' and starts_with(path, p)), 0) <= coalesce((select max(length(p)) from r where kind = 'a' and starts_with(path, p)), 0) as allowed from x"""
_FLOOR_SQL = """with r(p, kind) as (values ('/de/', 'd'), ('/en/7', 'd'), ('/en/', 'a')), x as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages),
f as (select page_id, path, (select max(p) from r where kind = 'd' and p <= path) as d, (select max(p) from r where kind = 'a' and p <= path) as a from x)
select page_id, coalesce(case when starts_with(path, d) then length(d) end, 0) <= coalesce(case when starts_with(path, a) then length(a) end, 0) as allowed from f"""


def _robots(spark: SparkSession, sf_dir: str, floor: bool) -> DataFrame:
    files = spark.createDataFrame([("any", _ROBOTS)], "server_key string, robots_txt string")
    found = robots.directives(robots.for_agent(robots.parse(files), "Mozilla anybot/1.0"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("any").alias("server_key"), uris.path(F.col("url")).alias("path"))
    return pages.join(found, "server_key", "left").select("page_id", robots.allows(F.col("path"), F.col("disallow"), F.col("allow"), floor).alias("allowed"))


@query(_RULE_SQL)
def robots_allow_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robots(spark, sf_dir, False)


@query(_FLOOR_SQL)
def robots_allow_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robots(spark, sf_dir, True)


# ---- extraction


@query("""select distinct url as src, replace(regexp_replace(h, '^[^"]*"|"$', '', 'g'), '&amp;', '&') as dst, 'a/@href' as context, 'L' as hop
    from (select url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a\\s+href="[^"]+"')) as h from pages)""")
def outlinks_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_links(table(spark, sf_dir, "pages"), resolve=False).filter("context = 'a/@href'")


@query()
def outlinks_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_links(table(spark, sf_dir, "pages"))


@query("""select page_id, ['a.gif', 'b&c.css', 'd.png'] as css, ['/x/y.html', 'http://a.example.com/z'] as script from pages""")
def outlinks_css_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = F.lit("p{background:url(a.gif)} @import 'b&amp;c.css'; q{src:url( \"d.png\" )}")
    script = F.lit("var t='text/html',u=\"/x/y.html\",v='1.5',w='http:\\/\\/a.example.com\\/z';")
    return table(spark, sf_dir, "pages").select("page_id", extract.css_links(css).alias("css"), extract.script_links(script).alias("script"))


@query("""with l as (select distinct url as src, 'http://' || host || p as dst, c as context, h as hop from (select url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages), (values ('/favicon.ico', '=INFERRED_MISC', 'I')) v(p, c, h))
    select src, dst, context, hop from l union select src, regexp_replace(dst, '^(.*)favicon\\.ico$', '\\1robots.txt'), context, 'I' from l""")
def implied_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumns({"headers": F.create_map(F.lit("x"), F.lit("y"))})
    found = extract.header_links(pages, "url", "headers").withColumn("dst", F.regexp_replace("dst", "^https:", "http:"))
    return extract.implied_links(found, r"(.*)favicon\.ico", "$1robots.txt")


@query("""select page_id, case when html like '<!DOCTYPE%' then 'utf-8' end as charset, sha1(html) as digest, sha1(regexp_replace(html, '[0-9]+', ' ', 'g')) as stripped from pages where contains(html, '<meta charset="utf-8">')""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter(F.contains("html", F.lit('<meta charset="utf-8">')))
    return pages.select("page_id", text.declared_charset(F.col("html")).alias("charset"), F.sha1("html").alias("digest"), text.text_digest(F.col("html"), "[0-9]+").alias("stripped"))
