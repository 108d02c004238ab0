"""Ordering, budgets, quotas, limits and waits of crawl queues, as window functions over batch tables.

Windows are partitioned by queue, server or host; limits over a whole crawl use ``running_total``, which
sums partitions first, so no task sorts the whole crawl.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import canonical, hops, uris

ORDER = ("scheduling", "precedence", "ordinal")


def prepare(rows: DataFrame, uri: str = "uri", via: str = "via", path: str = "hops") -> DataFrame:
    """What a candidate needs before it is queued: canonical form, sort key, queue, directive, cost, precedence."""
    u, v, h = F.col(uri), F.col(via), F.col(path)
    return rows.withColumns({
        "canonical": canonical.canonical(u), "surt": uris.surt(u), "class_key": uris.class_key(u), "scheduling": hops.scheduling(h),
        "cost": hops.cost_by_query(u, v), "precedence": F.least(hops.precedence_by_hops(h), F.lit(127)),
    })


def dequeue_order(rows: DataFrame, queue: str = "class_key") -> DataFrame:
    """rows with their turn in their queue."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(queue).orderBy(*ORDER)))


def next_of_queue(rows: DataFrame, queue: str = "class_key") -> DataFrame:
    """Each queue's head, by one aggregation."""
    key = F.struct(*ORDER)
    return rows.groupBy(queue).agg(F.min_by(F.struct(*rows.columns), key).alias("_r")).select("_r.*")


def _running(queue: str, order: list[str]) -> Window:
    return Window.partitionBy(queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def session_budget(rows: DataFrame, queue: str, order: list[str], cost: Column, budget: Column | int) -> DataFrame:
    """Running expenditure, and whether the queue rests before the row: when it has spent more than its session's budget."""
    spent = F.sum(cost).over(_running(queue, order))
    return rows.withColumns({"expenditure": spent, "over_session": spent > budget})


def total_budget(rows: DataFrame, queue: str, order: list[str], cost: Column, budget: Column | int, penalty: Column | int = 0) -> DataFrame:
    """Running expenditure with penalties for errors, and whether the queue is retired: when it has spent its budget."""
    spent = F.sum(cost + penalty).over(_running(queue, order))
    return rows.withColumns({"expenditure": spent, "retired": spent >= budget})


def quotas(rows: DataFrame, key: str, order: list[str], limits: dict[str, tuple[Column, int]]) -> DataFrame:
    """The first limit that earlier rows of a key have reached, as ``Q:name``; a limit of -1 is off.

    limits: name -> (what a row adds, most).  A fetch is checked before it is made, so its own row doesn't count.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.lit(None).cast("string")
    for name, (value, most) in reversed(limits.items()):
        if most >= 0:
            found = F.when(F.coalesce(F.sum(value).over(before), F.lit(0)) >= most, F.lit(f"Q:{name}")).otherwise(found)
    return rows.withColumn("quota", found)


def running_total(rows: DataFrame, order: str, values: dict[str, Column]) -> DataFrame:
    """Running sums over all rows in order: range partitions are summed, then each continues from its predecessors' sum.

    The partitions' sums are as many rows as there are partitions, so broadcasting them is bounded.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(order, [k / n for k in range(1, n)], 10_000)).first()[0] or []
    typed = F.array(*(F.lit(c) for c in sorted(set(cuts))))
    bucket = F.size(F.filter(typed, lambda c: c < F.col(order))) if cuts else F.lit(0)
    parted = rows.withColumn("_b", bucket)
    sums = parted.groupBy("_b").agg(*(F.sum(v).alias(f"_{k}") for k, v in values.items()))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = sums.select("_b", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in values))
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(F.broadcast(offsets), "_b")
    return out.select(*rows.columns, *((F.sum(v).over(within) + F.col(f"_{k}")).alias(k) for k, v in values.items()))


def crawl_limits(rows: DataFrame, order: str, size: Column, most_bytes: int, most_documents: int) -> DataFrame:
    """rows with running bytes and documents, and which limit has ended the crawl by then."""
    out = running_total(rows, order, {"bytes_so_far": size, "documents_so_far": F.lit(1)})
    return out.withColumn("ended_by", F.when(F.col("bytes_so_far") >= most_bytes, "bytes").when(F.col("documents_so_far") >= most_documents, "documents"))


def politeness_schedule(rows: DataFrame, queue: str, order: list[str], duration: str, delay: str) -> DataFrame:
    """Milliseconds from a queue's start at which each fetch begins: all earlier ones and their waits are over."""
    before = Window.partitionBy(queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("starts_at", F.coalesce(F.sum(F.col(duration) + F.col(delay)).over(before), F.lit(0)))


def error_streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """rows with how many failures in a row their key has had by then: islands between successes."""
    w = _running(key, order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    out = rows.withColumn("_island", island)
    streak = F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("streak", streak).drop("_island")


def due(rows: DataFrame, at: str, now: Column) -> DataFrame:
    """Rows whose time has come."""
    return rows.filter(F.col(at) <= now)


def snapshots(events: DataFrame, ts: str, seconds: int, counters: dict[str, Column], keep: int = 5) -> DataFrame:
    """Samples of a crawl at even intervals: totals so far, what the last interval added, its rate, the mean of the last few.

    Intervals are aggregated first; the windows then run over one row an interval.
    """
    each = events.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(*(F.sum(v).alias(k) for k, v in counters.items()))
    each = each.select(F.col("w.start").alias("start"), *counters)
    order = Window.orderBy("start")
    so_far, last = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1 - keep, 0)
    out = {}
    for k in counters:
        out |= {f"total_{k}": F.sum(k).over(so_far), f"rate_{k}": F.col(k) / float(seconds), f"recent_{k}": F.avg(k).over(last), f"stalled_{k}": F.coalesce(F.lag(k).over(order) == F.col(k), F.lit(False))}
    return each.withColumns(out)


def with_next(rows: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """rows with a column of the next row in a crawl-wide order; null for the last one.

    Rows are parted into ranges of the first column of the order and each range takes its last row's value from the
    first row of the next one that has any, so no task sorts more than a range.
    """
    first = order[0]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    number = F.unix_micros(F.col(first).cast("timestamp")) if rows.schema[first].dataType.typeName().startswith("timestamp") else F.col(first)
    marks = rows.select(F.percentile_approx(number, [k / parts for k in range(1, parts)]).alias("m")).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(marks)))).cast("array<long>")
    ranged = rows.withColumn("_range", F.coalesce(F.size(F.filter(cuts, lambda c: c < number)), F.lit(0)))
    within = Window.partitionBy("_range").orderBy(*order)
    begins = ranged.groupBy("_range").agg(F.min_by(column, F.struct(*order)).alias("_v"))  # a row a range
    after = begins.select((F.dense_rank().over(Window.orderBy("_range")) - 1).alias("_k"), F.col("_v").alias("_next"))
    here = begins.select("_range", F.dense_rank().over(Window.orderBy("_range")).alias("_k"))
    following = F.broadcast(here.join(after, "_k", "left").select("_range", "_next"))
    last = F.lead(F.lit(True)).over(within).isNull()
    out = ranged.withColumns({name: F.lead(column).over(within), "_last": last}).join(following, "_range")
    return out.select(*rows.columns, F.when(F.col("_last"), F.col("_next")).otherwise(F.col(name)).alias(name))
