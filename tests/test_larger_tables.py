"""Cases of larger tables: repeated URLs, streams that don't fit the driver, queues cut by batches."""

from __future__ import annotations

import datetime
import random

import duckdb
from pyspark.sql import functions as F

from tidemill.functions import uris
from tidemill.operators import extract, joins
from tidemill.plans import catalog, catalog_more
from tidemill.sources import archives
from tidemill.streaming import crawl


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_stream_frontier_orders_queues_that_batches_cut(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"q{rng.randrange(3)}", str(k), rng.randrange(9), k) for k in range(400)]
    rng.shuffle(rows)
    schema = "class_key string, uri string, cost int, ordinal long"
    stream = _stream(spark, rows, schema, str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = catalog_more._drained(crawl.frontier(stream, session=20, total=300), "append").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = crawl.frontier_batch(spark.createDataFrame(rows, schema), session=20, total=300).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_appended_rows_of_streams_stay_out_of_the_driver(spark, tmp_path):
    stream = _stream(spark, [(1,), (2,)], "k int", str(tmp_path / "in"))
    found = catalog_more._drained(stream, "append")
    assert sorted(r.k for r in found.collect()) == [1, 2] and len(found.inputFiles()) > 0
    nothing = catalog_more._drained(_stream(spark, [], "k int", str(tmp_path / "none")), "append")
    assert nothing.columns == ["k"] and nothing.count() == 0


def _same_as_sql(spark, name, tables, path):
    """Whether a query gives its SQL's rows over such tables, and so many rows that there is something to compare."""
    with duckdb.connect("", config={"threads": 1}) as duck:
        for table, frame in tables.items():
            frame.coalesce(1).write.parquet(f"{path}/{table}.parquet")
            duck.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
        result = duck.execute(catalog.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        want = sorted(result.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, str(path)).collect()), key=repr)
    assert want and got == want


def _repeated_pages(spark):
    """Pages of which every third URL occurs several times, each with a link of its own."""
    rows = [(k, f"http://a.example.com/{k % 40 if k % 3 else 0}", f'<a href="/to/{k}">x</a>') for k in range(120)]
    return {"pages": spark.createDataFrame(rows, "page_id long, url string, html string")}


def test_links_of_repeated_urls_follow_their_own_fetch(spark, tmp_path):
    _same_as_sql(spark, "candidate_links", _repeated_pages(spark), tmp_path)


def test_durations_beyond_a_day(spark, tmp_path):
    documents = spark.range(1580, 1700).selectExpr("id as doc_id", "'src1' as source", "'en' as lang")
    _same_as_sql(spark, "display_formats", {"documents": documents}, tmp_path)


def test_sizes_halfway_between_digits(spark, tmp_path):
    sizes = [0, 1023, 1024, 1279, 1280, 1281, 1792, 2304, 3328, 9983, 10239, 10240, 10752, 11776, 1048575, 1048576, 1310720, 1835008, 11010048]
    pages = spark.createDataFrame(list(enumerate(sizes)), "page_id long, n int").selectExpr("page_id", "'http://a.example/' as url", "repeat('x', n) as html")
    _same_as_sql(spark, "display_sizes", {"pages": pages}, tmp_path)


def test_seeds_of_repeated_urls_are_reported_once_a_fetch(spark, tmp_path):
    _same_as_sql(spark, "seeds_report", _repeated_pages(spark), tmp_path)


def test_first_of_repeated_parents(spark, tmp_path):
    _same_as_sql(spark, "via_self_join", _repeated_pages(spark), tmp_path)


def test_traps_by_the_page_that_led_there(spark, tmp_path):
    rows = [(0, "http://a.example/x", "A"), (1, "http://a.example/y", "B"), (2, "http://a.example/x", "B"), (3, "http://a.example/z", "A")]
    _same_as_sql(spark, "trap_suppression", {"pages": spark.createDataFrame(rows, "page_id long, url string, html string")}, tmp_path)


def test_order_says_which_parent_counts(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (2, "a", "x"), (1, "b", "a"), (4, "a", "x")], "n int, uri string, via string")
    for by, want in ((["n"], 2), ([rows.n * -1], 4)):
        assert [r.via_n for r in joins.with_via(rows, ["n"], order=by).filter("via_n is not null").collect()] == [want]


def test_archives_are_read_in_batches_of_bytes(spark, tmp_path):
    date = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [("response", f"http://a.example/{k}", date, {"X-K": str(k)}, bytes([k]) * (3 << 20)) for k in range(4)]
    frame = spark.createDataFrame(rows, "type string, target_uri string, date timestamp, headers map<string,string>, payload binary")
    archives.register(spark)
    frame.coalesce(1).write.format("webarchive").mode("append").save(str(tmp_path / "w"))
    [file] = (tmp_path / "w").glob("*.warc.gz")
    sizes = [b.num_rows for b in archives.ArchiveReader({"path": str(file)}).read(archives.File(str(file)))]
    assert sizes == [2, 2]
    read = spark.read.format("webarchive").load(str(tmp_path / "w")).collect()
    assert [(r.type, r.target_uri, r.date, {"X-K": r.headers["X-K"]}, bytes(r.payload)) for r in sorted(read, key=lambda r: r.offset)] == rows


def test_pages_and_links_are_read_once(spark):
    pages = spark.createDataFrame([("http://a.example/x/", '<a href="../y?p=1&amp;q=2">y</a><a href=" ">n</a><a href="&#35;z">n</a><img src="i.gif">')], "url string, html string")
    links = extract.html_links(pages)
    assert sorted((r.dst, r.hop) for r in links.collect()) == [("http://a.example/x/i.gif", "E"), ("http://a.example/y?p=1&q=2", "L")]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert plan.count("(?is)(<(script|style)") == 1 and plan.count("[\\n\\r\\t]+") == 1


def test_normalisation_stays_small(spark):
    text = spark.range(1).select(uris.normalise(F.lit("HTTP:\\\\A.example:080\\b\\..\\c d?e f#g")).alias("u"))
    assert text.first().u == "http://a.example/c%20d?e%20f"
    plan = spark.range(1).select(uris.normalise(F.col("id").cast("string")).alias("u"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 10_000


def test_crawl_rounds_extract_once(spark, tmp_path):
    rows = [(k, f"http://a.example.com/{k}", f'<a href="/{k + 1}">x</a><a href="/{k + 7}">y</a>') for k in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = catalog.queries()["crawl_rounds"](spark, str(tmp_path))
    assert "script" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for path, steps in (("LL", (2, 8, 14)), ("L", (1, 7)), ("", (0,))):
        want |= {f"http://a.example.com/{seed + n}": path for seed in (0, 10, 20) for n in steps}
    assert {r.uri: r.hops for r in found.collect()} == want
