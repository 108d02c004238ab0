"""Cases that were once cut: what an operator must find on the whole input."""

from __future__ import annotations

import random

from tidemill.operators import frontier, joins
from tidemill.streaming import crawl


def test_paths_of_any_length_and_cycles(spark):
    via = {k: k - 1 if k else None for k in range(150)}
    via |= {200: 200, 300: 302, 301: 300, 302: 301, 303: 302, 304: 303, 400: 999, 401: 400}
    via |= {k: k - 1 for k in range(1001, 1081)} | {1000: 1080, 1081: 1080}
    rows = spark.createDataFrame(list(via.items()), "uri int, via int")
    got = {r.uri: (r.seed, r.depth, r.path) for r in joins.paths_to_seeds(rows).collect()}
    assert got == {k: (0, k, list(range(k + 1))) for k in range(150)} | {400: (400, 0, [400]), 401: (400, 1, [400, 401])}
    assert joins.paths_to_seeds(rows.limit(0)).count() == 0


def test_queues_against_plain_states(spark):
    rng = random.Random(3)
    rows = [(f"q{rng.randrange(6)}", str(k), rng.randrange(9), k) for k in range(400)]
    want, queues = set(), {}
    for queue, uri, cost, _ in rows:
        turn, spent, session = queues.get(queue, (0, 0, 0))
        if spent >= 150:
            want.add((queue, uri, turn, spent, "retired"))
            continue
        turn, spent, session = turn + 1, spent + cost, session + cost
        state = "retired" if spent >= 150 else "inactive" if session > 20 else "active"
        queues[queue] = (turn, spent, 0 if state == "inactive" else session)
        want.add((queue, uri, turn, spent, state))
    candidates = spark.createDataFrame(rows, "class_key string, uri string, cost int, ordinal int").repartition(3)
    assert {tuple(r) for r in crawl.frontier_batch(candidates, session=20, total=150).collect()} == want


def test_next_rows_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50) if k % 9 else None, k) for k in range(300)]
    got = {r.k: r.n for r in frontier.with_next(spark.createDataFrame([r for r in rows if r[0] is not None], "t int, k int"), ["t", "k"], "k", "n").collect()}
    order = [k for _, k in sorted(r for r in rows if r[0] is not None)]
    assert got == dict(zip(order, [*order[1:], None]))
    assert frontier.with_next(spark.createDataFrame([], "t int, k int"), ["t", "k"], "k", "n").count() == 0
