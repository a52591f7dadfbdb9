"""The router as a stateful stream, and event windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataframe.operators.routing import OPERATIONS, SCHEMA, route

STATE = "ocr int, scene int, completion int, stopped boolean"


def routed_stream(requests: DataFrame) -> DataFrame:
    """Requests (run_id, seq, operation, s0, s1, s2), each run's batches in order; the cursors and the stop survive between batches."""

    def work(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, 0, False)
        cursor, stopped = dict(zip(OPERATIONS, held[:3], strict=True)), held[3]
        p = pd.concat(list(batches)).sort_values("seq")
        out, stopped = route(p[["run_id", "seq", "operation", "s0", "s1", "s2"]].itertuples(index=False), cursor, stopped)
        state.update((*(cursor.get(o, 0) for o in OPERATIONS), stopped))
        yield pd.DataFrame(out, columns=["run_id", "seq", "operation", "outcome", "selected", "n_attempts", "statuses"])

    return requests.groupBy("run_id").applyInPandasWithState(work, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Extension: events and their values by window and type; with ``late`` a watermark, for streams."""
    held = events.withWatermark("ts", late) if late else events
    return held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
