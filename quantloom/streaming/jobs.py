"""Decisions over a stream of job ops: the fold of operators.jobs with each desk's active jobs as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators import jobs as J
from quantloom.session import ship

STATE = "active array<struct<job_id:string,kind:string,dedup_key:string,status:string>>"


def decisions(ops: DataFrame, most: int = J.MOST_JOBS) -> DataFrame:
    """The columns of operators.jobs.FOLDED for every op of a stream, whose ops of a desk come in the order of seq from batch to batch.

    State is bounded by the desks and their active jobs, not by the log.
    """
    ship(ops.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        desk = J.Desk([tuple(x) for x in state.get[0]] if state.exists else [])
        out, _, desk = J.fold(pd.concat(list(batches)).sort_values("seq"), most, key[0], desk)
        state.update((desk.state(),))
        yield out

    rows = J.log_of(ops).where("desk IS NOT NULL")
    return rows.groupBy("desk").applyInPandasWithState(run, J.FOLDED, STATE, "append", GroupStateTimeout.NoTimeout)
