"""Routing of runs that are longer than a batch."""

from __future__ import annotations

import collections
import random

from strataframe.operators import routing


def test_runs_across_batches(spark):
    rng = random.Random(6)
    state = lambda: rng.choice(["success"] * 30 + ["missing", "unavailable", "auth_unavailable", "policy_refused"])
    rows = [(run, seq, rng.choice(routing.OPERATIONS), state(), state(), state()) for run in (1, 2, 3, 9) for seq in range(1, 120 if run == 9 else 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id long, seq long, operation string, s0 string, s1 string, s2 string")
    runs = collections.defaultdict(list)
    for r in sorted(rows):
        runs[r[0]].append(r)
    want = {r for own in runs.values() for r in routing.route(own, {}, False)[0]}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert {tuple(r) for r in routing.routed(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in routing.routed(df)._jdf.queryExecution().optimizedPlan().toString()  # no run is gathered in one cell
