"""Joins, dedup, archives, logs and streams on small tables."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from tidemill.operators import dedup, frontier, joins, recrawl, rules, stats
from tidemill.sources import archives, lines
from tidemill.streaming import crawl


def test_prefix_joins(spark):
    prefixes = spark.createDataFrame([(p,) for p in ("http://(org,a,", "http://(org,ex,www,)", "http://(org,ex,home,)/pages/", "http://(is,bok,", "http://(is,", "http://(is,bok,www")], "prefix string")
    small = joins.minimise_prefixes(prefixes)
    assert {r.prefix for r in small.collect()} == {"http://(org,a,", "http://(org,ex,www,)", "http://(org,ex,home,)/pages/", "http://(is,"}
    rows = spark.createDataFrame([(1, "http://(is,example,)/foo"), (2, "http://(org,ex,home,)"), (3, "http://(is,bok,www,)/"), (4, None)], "id int, surt string")
    assert {r.id for r in joins.prefix_semi(rows, "surt", small).collect()} == {1, 3}
    assert {r.id for r in joins.prefix_semi(rows, "surt", small, anti=True).collect()} == {2, 4}
    longest = {r.id: r.prefix for r in joins.longest_prefix(rows, "surt", prefixes).collect()}
    assert longest == {1: "http://(is,", 2: None, 3: "http://(is,bok,www", 4: None}
    assert joins.prefix_semi(rows, "surt", prefixes.limit(0)).count() == 0


def test_nearest_key_wraps_around(spark):
    marks = spark.createDataFrame([("m", "one"), ("t", "two")], "k string, target string")
    rows = spark.createDataFrame([("a",), ("m",), ("n",), ("z",)], "key string")
    assert {r.key: r.target for r in joins.next_key(rows, "key", marks, "k", "target").collect()} == {"a": "one", "m": "one", "n": "two", "z": "one"}


def test_as_of_join_takes_the_last_mark_even_if_null(spark):
    marks = spark.createDataFrame([("a", 1, "x"), ("a", 5, None), ("b", 3, "y")], "k string, t int, v string")
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("b", 3), ("c", 1)], "k string, t int")
    got = {(r.k, r.t): r.v for r in joins.as_of(rows, "k", "t", marks.withColumnRenamed("t", "mt"), "mt", ["v"]).collect()}
    assert got == {("a", 0): None, ("a", 1): "x", ("a", 4): "x", ("a", 9): None, ("b", 3): "y", ("c", 1): None}


def test_paths_follow_long_chains(spark):
    rows = spark.createDataFrame([(k, k - 1 if k else None) for k in range(50)], "uri int, via int")
    got = {r.uri: (r.seed, r.depth, r.path) for r in joins.paths_to_seeds(rows).collect()}
    assert got[49] == (0, 49, list(range(50))) and got[0] == (0, 0, [0])


def test_dedup_variants_agree(spark):
    rows = spark.createDataFrame([(k, f"u{k % 7}") for k in range(60)] + [(99, None)], "n int, k string")
    seen = spark.createDataFrame([("u1",), ("u3",)], "k string")
    exact = {(r.n, r.k) for r in dedup.unseen(rows, seen, "k", ["n"]).collect()}
    assert exact == {(k, f"u{k}") for k in (0, 2, 4, 5, 6)} | {(99, None)}
    bloom = dedup.first_by(dedup.unseen_bloom(rows, seen, "k", bits=64), "k", ["n"])
    assert {(r.n, r.k) for r in bloom.collect()} == exact
    assert {(r.n, r.k) for r in dedup.by_fingerprint(rows, "k", ["n"]).collect()} >= {(0, "u0"), (6, "u6")}


def test_top_n_follows_updates(spark):
    rows = spark.createDataFrame([("foo", 999, 1), ("bar", 101, 2)], "k string, v int, seq int")
    assert [r.k for r in stats.top(rows, "k", "v", 5, "seq").collect()] == ["foo", "bar"]
    later = rows.union(spark.createDataFrame([("foo", 9, 3)], rows.schema))
    assert [r.k for r in stats.top(later, "k", "v", 5, "seq").collect()] == ["bar", "foo"]


def test_running_total_equals_a_window(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("v"))
    got = {r.id: r.total for r in frontier.running_total(rows, "id", {"total": F.col("v")}).collect()}
    total = 0
    for k in range(1000):
        total += k * 37 % 101
        assert got[k] == total


def test_quota_counts_only_earlier_rows(spark):
    rows = spark.createDataFrame([("a", k) for k in range(4)], "k string, n int")
    got = [r.quota for r in frontier.quotas(rows, "k", ["n"], {"all": (F.lit(1), 2), "off": (F.lit(1), -1)}).orderBy("n").collect()]
    assert got == [None, None, "Q:all", "Q:all"]


def test_identical_digest_looks_at_the_newest_two(spark):
    rows = spark.createDataFrame([("u", 1, "x"), ("u", 2, "y"), ("u", 3, "x"), ("u", 4, "x"), ("v", 1, "x")], "u string, t int, digest string")
    got = recrawl.with_history(rows, "u", ["t"], ["t", "digest"]).select("u", "t", recrawl.identical_digest(F.col("history")).alias("same")).collect()
    assert {(r.u, r.t) for r in got if r.same} == {("u", 4)}


def test_shifted_status_wraps(spark):
    rows = spark.createDataFrame([(200,), (0,), (404,), (-1,), (2,)], "s int")
    got = [r.s for r in rows.orderBy(stats.shifted_status(F.col("s"))).collect()]
    assert got == sorted((200, 0, 404, -1, 2), key=lambda s: (-s - 2147483647 + 2**31) % 2**32 - 2**31)


# ---- archives


def response(k: int) -> tuple:
    return (f"http://{k}.example/ü", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * k)


@pytest.mark.parametrize("kind", ["warc", "arc"])
@pytest.mark.parametrize("zipped", ["true", "false"])
def test_archive_round_trip(spark, tmp_path, kind, zipped):
    archives.register(spark)
    rows = spark.createDataFrame([("response", *response(k)) for k in range(5)], "type string, target_uri string, payload binary").withColumn("date", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.coalesce(1).write.format("webarchive").option("archive", kind).option("gzip", zipped).option("maxBytes", 900).mode("append").save(str(tmp_path / "out"))
    files = list((tmp_path / "out").iterdir())
    assert len(files) > 1 and not any(f.name.endswith(".open") for f in files)
    read = spark.read.format("webarchive").load(str(tmp_path / "out")).filter("type = 'response'")
    got = read.collect()
    assert {(r.target_uri, bytes(r.payload)) for r in got} == set(map(response, range(5)))
    for r in got:
        [again] = archives.read_file(r.file, offset=r.offset, only=True)
        assert again[6] == r.target_uri and again[10] == bytes(r.payload)
    one = got[-1]
    assert read.filter((F.col("file") == one.file) & (F.col("offset") == one.offset)).count() == 1


def test_damaged_archives(spark, tmp_path):
    archives.register(spark)
    good = archives.warc_bytes("response", "http://a.example/", None, b"x" * 100)
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(gzip.compress(good) + gzip.compress(good)[:-30])
    got = list(archives.read_file(str(path)))
    assert [r[3] for r in got] == ["response", "corrupt"]
    with pytest.raises(ValueError, match="cut off"):
        list(archives.read_file(str(path), mode="FAILFAST"))
    with pytest.raises(ValueError, match="header"):
        archives.format_fields([("a", "b\r\nc")])


@pytest.mark.parametrize("kind", ["warc", "arc"])
def test_offsets_in_one_file_of_large_members(tmp_path, kind):
    import random

    body = random.Random(1).randbytes(200_000)
    make = (lambda k: archives.warc_bytes("response", f"http://{k}/", None, body)) if kind == "warc" else (lambda k: archives.arc_bytes(f"http://{k}/", None, None, "x/y", body))
    for name, pack in (("a", gzip.compress), ("b", bytes)):
        path = tmp_path / f"{name}.{kind}{'.gz' if name == 'a' else ''}"
        path.write_bytes(b"".join(pack(make(k)) for k in range(4)))
        records = list(archives.read_file(str(path)))
        assert [r[6] for r in records] == [f"http://{k}/" for k in range(4)]
        for r in records:
            assert next(archives.read_file(str(path), offset=r[1], only=True))[6] == r[6]


def test_header_fields_fold(spark):
    assert archives.parse_fields(b"A: 1\r\n  2\r\n# no\r\nB:3\r\nA: 4\r\n") == [("A", "1 2"), ("B", "3"), ("A", "4")]


# ---- lines


def test_seed_and_journal_lines(spark):
    text = spark.createDataFrame([(x,) for x in ("# no", "", " http://a.example/ more", "b.example", "+http://(org,", "-c.example")], "value string")
    assert [r.uri for r in lines.seeds(text).collect()] == ["http://a.example/", "http://b.example"]
    assert {(r.prefix, r.decision) for r in lines.directives(text).filter("decision = 'REJECT'").collect()} == {("http://(example,c,", "REJECT")}
    assert [r.prefix for r in lines.surt_prefixes(text, deduce=True).collect()] == ["http://(org,", "http://(example,a,)/", "http://(example,b,"]
    journal = spark.createDataFrame([("F+ http://a/ LL http://b/",), ("Fs http://a/",), ("junk",)], "value string")
    assert [tuple(r) for r in lines.journal(journal).collect()] == [("F+", "http://a/", "LL", "http://b/"), ("Fs", "http://a/", None, None)]


def test_pages_of_logs(spark):
    log = spark.createDataFrame([(k, f"line {k % 3}") for k in range(12)], "line_no int, value string")
    assert [r.line_no for r in lines.grep(log, "2$", skip=1, most=2).collect()] == [5, 8]
    assert [r.line_no for r in lines.tail(log, 2).collect()] == [10, 11]
    assert lines.first_line(log, "^line 1").first().line_no == 1


# ---- streams


def test_stream_frontier_equals_the_batch(spark, tmp_path):
    rows = [(f"q{k % 3}", f"u{k}", k * 7 % 5 + 1, k) for k in range(60)]
    candidates = spark.createDataFrame(rows, "class_key string, uri string, cost int, ordinal long")
    candidates.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(candidates.schema).parquet(str(tmp_path / "in"))
    waiting = crawl.frontier(stream, session=9, total=40).writeStream.format("memory").queryName("turns").outputMode("append").trigger(availableNow=True).start()
    waiting.awaitTermination()
    got = {tuple(r) for r in spark.table("turns").collect()}
    assert got == {tuple(r) for r in crawl.frontier_batch(candidates, session=9, total=40).collect()}
    assert {r[4] for r in got} == {"active", "inactive", "retired"}


def test_gate_and_limits(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    assert [r.x for r in rules.gate(rows, F.col("n") > 1, {"x": F.col("n") * 10}).orderBy("n").collect()] == [None, 20, 30]
    assert {r.n for r in rules.limit_per_key(rows, "k", ["n"], 1).collect()} == {1, 3}
