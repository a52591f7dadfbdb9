"""Contexts of completions: the largest limit of labels against a search over all limits."""

from __future__ import annotations

import random

from strataframe.operators import candidates


def test_limit_of_labels(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(page, rng.choice(["rear", "front"]), f"n{k:03d}", rng.choice([None, "", "ä" * rng.randint(0, 400), "x" * rng.randint(0, 300)])) for page in range(40) for k in range(rng.randint(1, 24))]
    df = spark.createDataFrame(rows, "slide_id long, side string, node_id string, label string")
    for most in (260, 700, 1500, 8192):
        monkeypatch.setattr(candidates, "CONTEXT_BYTES", most)
        want = set()
        for page in range(40):
            held = [r for side in ("rear", "front") for r in sorted(r[1:] for r in rows if r[0] == page and r[1] == side)[:8]]
            size = lambda u: 200 + sum(40 + len(i) + len((t or "")[:u].encode()) for _, i, t in held)  # noqa: B023, E731
            fits = [u for u in range(201) if size(u) <= most]
            want |= {(page, s, i, (t or "")[: fits[-1]]) for s, i, t in held if fits}
        assert {tuple(r) for r in candidates.context_nodes(df).collect()} == want
    plan = candidates.context_nodes(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and plan.index("Window") < plan.index("substring(coalesce(label")  # a child is printed below its parent: labels are cut before they are sorted


def test_targets_in_one_aggregate(spark):
    nodes = spark.createDataFrame([(1, "a", "icon"), (1, "b", "text"), (1, "c", "icon"), (2, "a", "background"), (3, "z", "icon"), (3, "y", "icon"), (None, "a", "icon")], "slide_id long, node_id string, role string")
    asked = spark.createDataFrame([(1, "c"), (1, "a"), (1, "a"), (1, "b"), (1, "?"), (2, "a"), (3, None), (3, "y"), (3, "z"), (4, "a"), (None, "a")], "slide_id long, node_id string")
    out = candidates.target_nodes(asked, nodes)
    assert sorted((r.slide_id, r.targets) for r in out.collect()) == [(1, ["a", "c"]), (3, ["y", "z"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1  # no task sorts and hashes the same rows for several operators
