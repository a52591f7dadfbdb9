"""Aggregates and windows in place of sorted structs and joins of a table with itself."""

from __future__ import annotations

from strataframe.operators import graph, selection


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_first_padding_hashes(spark):
    tries = [(1, 4, False, False), (1, 8, True, True), (1, 12, True, False), (2, 4, False, False), (2, 8, False, False), (3, 8, True, False), (3, 4, False, True)]
    df = spark.createDataFrame(tries, "k long, padding int, transparent boolean, hopeless boolean")
    out = selection.first_padding(df, "k")
    assert sorted(map(tuple, out.collect())) == [(1, 8, True), (2, 8, False), (3, 4, False)]
    assert out.schema["padding"].dataType == df.schema["padding"].dataType and "SortAggregate" not in plan(out)[1]

def test_contradictions_without_join(spark):
    said = [(1, "a", "behind", "x", "y"), (1, "b", "in-front-of", "x", "y"), (1, "c", "behind", "x", "z"), (2, "d", "behind", "y", "x"), (1, "e", "behind", "w", "w"), (1, "f", "behind", "x", "y"), (1, "g", "behind", "x", None)]
    out = graph.contradictions(spark.createDataFrame(said, "slide_id long, rel_id string, kind string, from_id string, to_id string"))
    assert sorted(map(tuple, out.collect())) == [(1, "a", "x", "y"), (1, "b", "y", "x"), (1, "e", "w", "w"), (1, "f", "x", "y")]
    assert "Join" not in plan(out)[0]
