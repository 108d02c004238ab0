"""Column functions on examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.functions import canonical, hops, robots, text, uris
from tidemill.operators import extract, rules


@pytest.fixture
def of(spark):
    def apply(function, *values):
        row = spark.createDataFrame([(0,)], "x int").select(function(*(F.lit(v) for v in values)).alias("r"))
        return row.first().r

    return apply


ID32, ID24 = "0123456789abcdef0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWX"


@pytest.mark.parametrize(
    ("rule", "url", "expected"),
    [
        (canonical.strip_session_ids, f"http://a.example/x?jsessionid={ID32}", "http://a.example/x?"),
        (canonical.strip_session_ids, f"http://a.example/x?jsessionid={ID32}0", f"http://a.example/x?jsessionid={ID32}0"),
        (canonical.strip_session_ids, f"http://a.example/x?jsessionid={ID32}&x=y", "http://a.example/x?x=y"),
        (canonical.strip_session_ids, f"http://a.example/x?one=two&PHPSESSID={ID32}", "http://a.example/x?one=two&"),
        (canonical.strip_session_ids, f"http://a.example/x?aspsessionidABCDEFGH={ID24}&x=y", "http://a.example/x?x=y"),
        (canonical.strip_session_ids, f"http://a.example/x?sid={ID32}&jsessionid={ID32}", "http://a.example/x?"),
        (canonical.strip_coldfusion_ids, "http://a.example/x?CFID=1&CFTOKEN=2&dt=3", "http://a.example/x?dt=3"),
        (canonical.strip_numbered_www, "http://www12.a.example/x", "http://a.example/x"),
        (canonical.strip_numbered_www, "http://www.a.example/", "http://www.a.example/"),
        (canonical.strip_www, "https://www.a.example/x", "https://a.example/x"),
        (canonical.strip_userinfo, "ftp://me:pw@a.example/x@y", "ftp://a.example/x@y"),
        (canonical.strip_extra_slashes, "http://a.example//x///y", "http://a.example/x/y"),
        (canonical.fixup_query, "http://a.example/x?", "http://a.example/x"),
        (canonical.fixup_query, "http://a.example/x?&", "http://a.example/x"),
        (canonical.fixup_query, "http://a.example/x?&a=b&", "http://a.example/x?a=b&"),
        (canonical.fixup_query, "http://a.example/x?a=b&", "http://a.example/x?a=b"),
        (canonical.canonical, f"http://WWW.a.example/Index.html?jsessionid={ID32}", "http://a.example/index.html"),
        (canonical.rewrite(r"http://(\w+)\.example/.*", "$1"), "http://a.example/x", "a"),
        (canonical.canonical, None, None),
    ],
)
def test_canonical_forms(of, rule, url, expected):
    assert of(rule, url) == expected


@pytest.mark.parametrize(
    ("uri", "key"),
    [
        ("http://www.site.example", "http://(example,site,www,)"),
        ("http://www.site.example/Films/x.php", "http://(example,site,www,)/films/x.php"),
        ("http://www.site.example:8080/x", "http://(example,site,www,:8080)/x"),
        ("http://user:pw@www.site.example:8080/x", "http://(example,site,www,:8080@user:pw)/x"),
        ("http://www.site.example/u@v", "http://(example,site,www,)/u@v"),
        ("http://10.20.30.40/q", "http://(10.20.30.40)/q"),
        ("mailto:x", "mailto:x"),
    ],
)
def test_sort_keys(of, uri, key):
    assert of(uris.surt, uri) == key


@pytest.mark.parametrize(
    ("seed", "prefix"),
    [
        ("http://www.site.example/index.html", "http://(example,site,www,)/"),
        ("https://red.green.blue", "http://(blue,green,red,"),
        ("https://pink.green.blue/q/r/", "http://(blue,green,pink,)/q/r/"),
        ("https://grey.green.blue/q/r/s", "http://(blue,green,grey,)/q/r/"),
        ("bare.green.blue/x", "http://(blue,green,bare,)/"),
    ],
)
def test_prefixes_of_seeds(of, seed, prefix):
    assert of(uris.surt_prefix, seed) == prefix


def test_prefix_truncation(of):
    assert of(uris.host_prefix, "http://(com,example,www,)/a/b") == "http://(com,example,www,)"
    assert of(uris.domain_prefix, "http://(com,example,www,)/a/b") == "http://(com,example,"


def test_normalisation(of):
    assert of(uris.normalise, " HTTP://Me@WWW.Example.COM:080\\a b?x\\y#z\n") == "http://Me@www.example.com/a%20b?x\\y"
    assert of(uris.normalise, "https:////example.com:443") == "https://example.com/"
    assert of(uris.normalise, "http://example.com/../../a") == "http://example.com/a"
    assert of(uris.normalise, "no uri") is None and of(uris.normalise, "http://a/" + "x" * 3000) is None
    assert of(uris.server_key, "https://example.com/x") == "example.com:443"
    assert of(uris.assigned_domain, "http://a.b.example.co.uk/") == "example.co.uk"


def test_resolution(spark):
    cases = [("http://a.example/b/c", "d", "http://a.example/b/d"), ("http://a.example/b/c", "//h/x", "http://h/x"), ("http://a.example/b", "http://bücher.example/ü", "http://xn--bcher-kva.example/%C3%BC"), ("http://a.example", None, None)]
    got = spark.createDataFrame([c[:2] for c in cases], "b string, r string").select(uris.resolve("b", "r").alias("x")).collect()
    assert [r.x for r in got] == [c[2] for c in cases]


def test_hops(of):
    assert of(hops.hop_count, "12+LLE") == 15 and of(hops.hop_count, None) == 0
    assert of(hops.extend, "L" * 50, "E") == "1+" + "L" * 49 + "E"
    assert of(hops.extend, "3+" + "L" * 50, "E") == "4+" + "L" * 49 + "E"
    assert [of(hops.transcluded, h) for h in ("LE", "L", "LEEE", "LXX", "LRRE", "", "LX")] == [True, False, False, False, True, False, True]
    assert of(lambda s: hops.outcome(s, F.lit(1)), 404) == "success" and of(lambda s: hops.outcome(s, F.lit(1)), -9998) == "disregard"
    assert of(lambda s: hops.outcome(s, F.lit(30)), -2) == "failure"
    assert [of(lambda n: hops.precedence_by_success(n), n) for n in (99, 100, 1099, 1100, 2100)] == [3, 4, 4, 5, 6]
    assert of(lambda d: hops.politeness_delay(d, F.lit(400.0)), 100) == 300_000


def test_rules(of):
    assert of(lambda u: rules.matches_list(u, []), "x") is False and of(lambda u: ~rules.matches_list(u, []), "x") is True
    assert of(lambda u: rules.full(u, "a|b"), "ab") is False
    assert of(rules.repeats_segment, "http://e.example/a/a/a/b") is True and of(rules.repeats_segment, "http://e.example/a/a/b") is False
    sequence = [rules.reject(), rules.rule(F.lit(True)), rules.rule(F.lit(False), rules.REJECT), rules.accept()]
    assert of(lambda _: rules.last_word(sequence), 1) == "ACCEPT" and of(lambda _: rules.decisive(sequence), 1) == 1
    assert of(rules.invert, "ACCEPT") == "REJECT" and of(rules.invert, None) is None
    assert of(lambda n: rules.content_length(n, 10), None) == "REJECT"


def test_texts(of):
    assert of(text.mime, "Text/HTML; charset=x") == "Text/HTML" and of(text.mime, None) == "no-type"
    assert of(text.display_duration, 93_784_005) == "1d2h3m4s5ms"
    assert of(text.display_bytes, 1536) == "1.5 KiB" and of(text.display_bytes, 12 * 1024**2) == "12 MiB"
    assert str(of(text.parse_digits_date, "2004")) == "2004-01-01 00:00:00" and of(text.parse_digits_date, "x") is None
    assert of(text.digest, "abc") == "sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"
    assert of(text.declared_charset, "<meta http-equiv=x content='text/html; charset=latin-1'>") == "latin-1"
    assert of(text.declared_charset, "<?xml version='1.0' encoding='UTF-8'?>") == "UTF-8"
    assert of(text.unescape_html, "a &lt; b") == "a < b"


ROBOTS = """User-agent: *
Disallow: /cgi-bin/
Disallow: /details/software

User-agent: denybot
Disallow: /   # all

User-agent: allowbot1
Disallow:

User-agent: allowbot2
Disallow: /foo
Allow: /

User-agent: delaybot
Disallow: /
Crawl-delay: 20
Allow: /images/
"""


@pytest.mark.parametrize("body", [ROBOTS, "\n".join("  " + line for line in ROBOTS.split("\n")), "<html><pre>" + ROBOTS + "</pre></html>"])
def test_robots(spark, body):
    rules_ = robots.parse(spark.createDataFrame([("s", body)], "server_key string, robots_txt string"))

    def ask(agent, path):
        row = robots.directives(robots.for_agent(rules_, agent)).select(robots.allows(F.lit(path), F.col("disallow"), F.col("allow")).alias("ok"), "delay").first()
        return row.ok, row.delay

    assert ask("Mozilla allowbot1 99.9", "/path")[0]
    assert not ask("Mozilla allowbot2 99.9", "/foo")[0]
    assert ask("Mozilla denybot 99.9", "/") == (False, -1.0)
    assert not ask("Mozilla anonbot 99.9", "/cgi-bin/foo.pl")[0] and ask("Mozilla anonbot 99.9", "/x")[0]
    assert ask("Mozilla delaybot 99.9", "/images/x") == (True, 20.0)


def test_robots_floor_may_miss_a_prefix(of):
    both = lambda floor: lambda path: robots.allows(path, F.array(F.lit("/a"), F.lit("/a/b")), F.array().cast("array<string>"), floor)
    assert of(both(True), "/a/c") is True and of(both(False), "/a/c") is False


HTML = """<html><head><base href="http://b.example/start/"><link href=style.css></head><body><!-- <a href="no"> -->
<A HREF="http://x.example">x</a><a href='http://x.example'/><a href=http://x.example>unclosed<img src="foo.gif">
<frame name="main"src="http://f.example/"><form action="/go?a=1&amp;b=2"></form><a href="javascript:x()">j</a><a href="#top">t</a></body></html>"""


def test_links_of_a_page(spark):
    pages = spark.createDataFrame([("http://p.example/", HTML), ("http://q.example/", "<meta name=robots content='noindex,nofollow'><a href=x>"), ("http://r.example/", None)], "url string, html string")
    got = {(r.dst, r.context, r.hop) for r in extract.html_links(pages).collect()}
    assert got == {
        ("http://x.example/", "a/@href", "L"), ("http://b.example/start/foo.gif", "img/@src", "E"), ("http://b.example/start/style.css", "link/@href", "E"),
        ("http://f.example/", "frame/@src", "E"), ("http://b.example/go?a=1&b=2", "form/@action", "L"),
    }


def test_links_of_other_content(of, spark):
    assert of(extract.xml_links, '<rss><link>http://a.example/?x&amp;y</link><e u="https://b.example/"/></rss>') == ["http://a.example/?x&y", "https://b.example/"]
    assert of(extract.query_links, "http://a.example/?u=http%3A%2F%2Fb.example%2Fx&v=1") == ["http://b.example/x"]
    assert of(extract.refresh_target, '<meta http-equiv="refresh" content="5; url=/next.html">') == "/next.html"
    headers = spark.createDataFrame([("https://a.example/x", {"location": "/y"})], "url string, headers map<string,string>")
    got = {(r.dst, r.hop) for r in extract.header_links(headers, "url", "headers", root_page=True).collect()}
    assert got == {("/y", "R"), ("https://a.example/favicon.ico", "I"), ("https://a.example/", "I")}
