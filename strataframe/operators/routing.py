"""Sticky forward-only routing of a run's requests over three candidates, in order."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values, in the order in which they are tried.
CANDIDATES = ("host-openai", "api-openai", "api-alibaba")
FALLBACK = ("unavailable", "auth_unavailable", "retryable_exhausted")
OPERATIONS = ("ocr", "scene", "completion")
SCHEMA = "run_id long, seq long, operation string, outcome string, selected string, n_attempts long, statuses string"


def step(cursor: dict[str, int], operation: str, statuses: tuple[str, ...]) -> tuple[str, str | None, list[str], bool]:
    """(outcome, selected, statuses seen, stops): a success keeps the candidate for the operation; a missing one is passed over; three failures pass on; any other stops the run."""
    seen: list[str] = []
    for k in range(cursor.get(operation, 0), len(CANDIDATES)):
        status = statuses[k]
        seen.append("unavailable" if status == "missing" else status)
        if status == "success":
            cursor[operation] = k
            return "success", CANDIDATES[k], seen, False
        if status != "missing" and status not in FALLBACK:
            return "fatal", None, seen, True
    return "exhausted", None, seen, True


def route(rows: Iterable[tuple], cursor: dict[str, int], stopped: bool) -> tuple[list[tuple], bool]:
    """Rows are (run_id, seq, operation, s0, s1, s2) in order."""
    out = []
    for run, seq, operation, *statuses in rows:
        if stopped:
            out.append((run, seq, operation, "stopped", None, 0, ""))
            continue
        outcome, selected, seen, stopped = step(cursor, operation, tuple(statuses))
        out.append((run, seq, operation, outcome, selected, len(seen), ",".join(seen)))
    return out, stopped


def routed(requests: DataFrame) -> DataFrame:
    """Batch form: each run's requests in order of seq. Runs pass through as sorted rows, so a task holds one batch of rows, however long a run is."""

    fields = ("run_id", "seq", "operation", "s0", "s1", "s2")
    arrow = to_arrow_schema(T._parse_datatype_string(SCHEMA))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, cursor, stopped = None, {}, False  # of the run that the last batch ended in
        for batch in batches:
            out = []
            for own, held in itertools.groupby(zip(*(batch.column(f).to_pylist() for f in fields), strict=True), lambda r: r[0]):
                if own != run:
                    run, cursor, stopped = own, {}, False
                done, stopped = route(held, cursor, stopped)
                out += done
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return requests.select(*fields).repartition("run_id").sortWithinPartitions("run_id", "seq").mapInArrow(rows, SCHEMA)


def attempt_counts(routed_rows: DataFrame) -> DataFrame:
    """Attempts by operation and status."""
    each = routed_rows.where("statuses <> ''").select("operation", F.explode(F.split("statuses", ",")).alias("status"))
    return each.groupBy("operation", "status").agg(F.count(F.lit(1)).alias("n"))
