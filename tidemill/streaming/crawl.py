"""Crawl events as streams: samples, dedup, and a frontier whose queues are keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sampled(events: DataFrame, ts: str, interval: str, late: str, aggregates: list[Column]) -> DataFrame:
    """Tumbling samples of a stream; events later than ``late`` are dropped and old windows' state goes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, interval).alias("w")).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Activity of each key between pauses of at least ``gap``."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unseen(events: DataFrame, key: str, ts: str | None = None, late: str | None = None) -> DataFrame:
    """First events of each key; with a time and a bound, state older than it goes."""
    if ts and late:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def generation(ts: Column, digits: int = 10) -> Column:
    """The partition that an event is written to: its date, cut to some digits."""
    return F.substr(F.date_format(ts, "yyyyMMddHHmmss"), F.lit(1), F.lit(digits))


STATES = ("active", "inactive", "retired")
FRONTIER = "queue string, uri string, turn long, expenditure long, state string"


def frontier(candidates: DataFrame, session: int = 3000, total: int = 1 << 62, queue: str = "class_key") -> DataFrame:
    """Turns, expenditure and state of the queues as candidates (queue, uri, cost, ordinal) come in.

    A queue's state is three numbers whatever its length: turns taken, spent in all, spent in this session.
    A queue whose session is spent is inactive and begins a new one with its next candidate; one whose total
    is spent is retired, its candidates pass with that state and cost nothing.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, spent, spent_now = state.get if state.exists else (0, 0, 0)
        # Spark cuts a queue's rows into Arrow batches anywhere, so that only all of them together have an order
        batch = pd.concat(list(batches)).sort_values("ordinal")
        turns, expenditures, states = [], [], []
        for cost in batch["cost"].tolist():
            what = "retired"
            if spent < total:
                turn, spent, spent_now = turn + 1, spent + int(cost), spent_now + int(cost)
                what = "retired" if spent >= total else "inactive" if spent_now > session else "active"
                spent_now = 0 if what == "inactive" else spent_now
            turns.append(turn)
            expenditures.append(spent)
            states.append(what)
        yield pd.DataFrame({"queue": key[0], "uri": batch["uri"].to_numpy(), "turn": turns, "expenditure": expenditures, "state": states})
        state.update((turn, spent, spent_now))

    grouped = candidates.select(F.col(queue).alias("queue"), "uri", "cost", "ordinal").groupBy("queue")
    return grouped.applyInPandasWithState(advance, FRONTIER, "turn long, spent long, spent_now long", "append", GroupStateTimeout.NoTimeout)


def frontier_batch(candidates: DataFrame, session: int = 3000, total: int = 1 << 62, queue: str = "class_key") -> DataFrame:
    """The same over a table: each queue is folded in order; a queue is split over nothing, as its states follow one another."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, turn, spent, spent_now = [], 0, 0, 0
        for r in rows.sort_values("ordinal").itertuples():
            if spent >= total:
                out.append((key[0], r.uri, turn, spent, "retired"))
                continue
            turn, spent, spent_now = turn + 1, spent + int(r.cost), spent_now + int(r.cost)
            what = "retired" if spent >= total else "inactive" if spent_now > session else "active"
            spent_now = 0 if what == "inactive" else spent_now
            out.append((key[0], r.uri, turn, spent, what))
        return pd.DataFrame(out, columns=["queue", "uri", "turn", "expenditure", "state"])

    return candidates.select(F.col(queue).alias("queue"), "uri", "cost", "ordinal").groupBy("queue").applyInPandas(fold, FRONTIER)
