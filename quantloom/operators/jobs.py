"""The life of jobs as a fold over the log of what was asked: who may start, what is refused and why, and what became of each.

A log has rows (desk, seq, op, job_id, kind, dedup_key, status, error); seq orders a desk's rows, desks don't
meet. The ops:

* start: a job in the background. Refused as duplicate_pending while the desk has an active job of this kind (with a
  dedup_key: one of this kind and key), and as max_jobs_reached while it has MOST_JOBS active jobs.
* submit: a job that waits; run: one that runs at once. Neither is refused; an id that the desk has is taken over.
* finish: the job's row gets the given status and error, whatever it was. Nothing happens without a row.
* exit: the job's process has gone; a running job becomes an error with the reason child_exited.
* cancel: an active job becomes cancelled; refused for others.
* delete: the row goes.

Whether a start is refused depends on all earlier decisions of the desk, so each desk is a fold in order. It
holds the active jobs only; rows of a desk stream past, and the state of each job in the end comes from a window
over its own rows. The same fold keeps its state between micro-batches in streaming.jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import saved, ship

MOST_JOBS = 2
OPS = ("start", "submit", "run", "finish", "exit", "cancel", "delete")
COLUMNS = ["desk", "seq", "op", "job_id", "kind", "dedup_key", "status", "error"]
#: other_id is the job that a refused start meets.
FOLDED = "desk string, seq long, op string, job_id string, kind string, dedup_key string, status string, error string, ok boolean, reason string, other_id string, n_active int"


class Desk:
    """The active jobs of a desk in order of their start: id -> (kind, key, status)."""

    def __init__(self, active: list | None = None):
        self.active: dict[str, tuple] = {x[0]: tuple(x[1:]) for x in active or []}

    def state(self) -> list[tuple]:
        return [(job, *x) for job, x in self.active.items()]

    def step(self, op: str, job: str, kind: str | None, key: str | None, status: str | None, most: int) -> tuple[bool, str | None, str | None]:
        """(ok, reason, other job)."""
        if op == "start":
            same = [j for j, (k, d, _) in self.active.items() if k == kind and (key is None or d == key)]
            if same:
                return False, "duplicate_pending", same[-1]
            if len(self.active) >= most:
                return False, "max_jobs_reached", None
            self.active[job] = (kind, key, "running")
        elif op in ("submit", "run"):
            self.active[job] = (kind, key, "queued" if op == "submit" else "running")
        elif op == "finish":
            if status in ("running", "queued") and job in self.active:
                self.active[job] = (*self.active[job][:2], status)
            elif status not in ("running", "queued"):
                self.active.pop(job, None)
        elif op == "exit":
            if self.active.get(job, (None, None, None))[2] != "running":
                return False, "not_running", None
            del self.active[job]
        elif op == "cancel":
            if job not in self.active:
                return False, "not_cancellable", None
            del self.active[job]
        elif op == "delete":
            self.active.pop(job, None)
        else:
            return False, "unknown_op", None
        return True, None, None


def _none(x):
    return None if x is None or x != x else x


def fold(rows: pd.DataFrame, most: int, key: str | None = None, desk: Desk | None = None) -> tuple[pd.DataFrame, str | None, Desk]:
    """(rows with what became of each, the last desk's name, the last desk): rows (COLUMNS) come by desk and in order; key and desk are those before."""
    out, desk = [], desk or Desk()
    for r in rows[COLUMNS].itertuples(index=False):
        if r.desk != key:
            key, desk = r.desk, Desk()
        result = desk.step(r.op, r.job_id, _none(r.kind), _none(r.dedup_key), _none(r.status), most)
        out.append((*map(_none, r), *result, len(desk.active)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")]), key, desk


def _folded(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, desk = None, None
        for b in batches:
            out, key, desk = fold(b, most, key, desk)
            yield out

    return run


def log_of(ops: DataFrame) -> DataFrame:
    kinds = {"seq": "long"}
    return ops.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def decisions(ops: DataFrame, most: int = MOST_JOBS) -> DataFrame:
    """desk, seq, op, job_id, ok, reason, other_id, n_active, status of every row of the log.

    status is that of the job's row after the op, null without one. A refused cancel's reason names the job's
    status, or says that there is no such job. Rows without a desk are not taken up.
    """
    ship(ops.sparkSession)
    rows = log_of(ops).where("desk IS NOT NULL").repartition("desk").sortWithinPartitions("desk", "seq")
    done = saved(rows.mapInPandas(_folded(most), FOLDED), "jobs")
    order = Window.partitionBy("desk", "job_id").orderBy("seq")
    made = F.col("ok") & F.col("op").isin("start", "submit", "run")
    # The row's life: it begins with what makes it and ends with what deletes it.
    life = F.last(F.when(made, F.lit(True)).when(F.col("op") == "delete", F.lit(False)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    to = F.when(made, F.when(F.col("op") == "submit", "queued").otherwise("running"))
    to = to.when((F.col("op") == "exit") & F.col("ok"), "error").when((F.col("op") == "cancel") & F.col("ok"), "cancelled")
    rows = done.withColumn("there", F.coalesce(life, F.lit(False)))
    to = to.when((F.col("op") == "finish") & F.col("there"), F.col("status"))
    why = F.when((F.col("op") == "exit") & F.col("ok"), "child_exited").when((F.col("op") == "finish") & F.col("there"), F.coalesce("error", F.lit(""))).when(F.col("op") == "delete", "")
    now = F.when(F.col("there"), F.last("to", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"to": to, "why": why}).withColumns({"status": now, "error": F.nullif(F.when(F.col("there"), F.last("why", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))), F.lit(""))})
    refused = F.when(F.col("reason") == "not_cancellable", F.when(F.col("there"), F.concat(F.lit("job not cancellable: "), F.col("status"))).otherwise(F.concat(F.lit("unknown job "), F.col("job_id")))).otherwise(F.col("reason"))
    return rows.select("desk", "seq", "op", "job_id", "kind", "ok", refused.alias("reason"), "other_id", "n_active", "status", "error", "there")


def jobs(decided: DataFrame) -> DataFrame:
    """desk, job_id, kind, status, error, created_seq, updated_seq of the rows that are left; `decided` as of decisions()."""
    touched = (F.col("ok") & F.col("op").isin("start", "submit", "run", "cancel", "exit")) | (F.col("op") == "finish")
    made = F.col("ok") & F.col("op").isin("start", "submit", "run")
    rows = decided.withColumn("gone_at", F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy("desk", "job_id")))
    kept = F.col("seq") > F.coalesce("gone_at", F.lit(-(1 << 62)))
    out = rows.groupBy("desk", "job_id").agg(
        F.max_by("there", "seq").alias("there"), F.max_by("kind", F.when(made, F.col("seq"))).alias("kind"), F.max_by("status", "seq").alias("status"), F.max_by("error", "seq").alias("error"),
        F.min(F.when(made & kept, F.col("seq"))).alias("created_seq"), F.max(F.when(touched & kept, F.col("seq"))).alias("updated_seq"),
    )
    return out.where("there").drop("there")
