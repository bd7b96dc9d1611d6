"""Chains of correlated factors: a factor extends the chain of the member that it is closest to, if it beats that chain.

Records come in order. Each is compared with all members so far: if none has a correlation of `least` or more
in absolute value, the record begins a chain; else that of the closest member counts (ties: the older chain,
then the earlier position), which is extended if the record's rank_ic exceeds that of all its members, and the
record is rejected otherwise. A member's missing rank_ic, or one of 0, is exceeded by any; a record without
one exceeds none.

What a record meets depends on earlier decisions, but only within its group of linked records. So Spark finds the
correlations and the groups, and each group is a fold over its records in order. Held in a fold are the group's
members by name, no series; groups are dealt out over tasks, and their rows stream past.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import series as S
from quantloom.operators.links import groups, running_total
from quantloom.session import saved, ship

LEAST = 0.7
DECIDED = "seq long, record_id string, action string, head string, position int, best_member_position int, rank_ic double"


class Chains:
    """The members of one group so far, by record: (head, head's place, position), and what a newcomer has to exceed."""

    def __init__(self):
        self.members: dict[str, tuple[str, int, int]] = {}
        self.bar: dict[str, float] = {}
        self.size: dict[str, int] = {}

    def add(self, record: str, head: str, place: int, rank_ic: float | None) -> int:
        position = self.size.get(head, 0)
        self.members[record] = (head, place, position)
        self.size[head] = position + 1
        self.bar[head] = max(self.bar.get(head, -math.inf), rank_ic or -math.inf)
        return position

    def decide(self, seq: int, record: str, rank_ic: float | None, near: list[tuple[str, float]]) -> tuple:
        """(action, head, position, best member's position) of a record with its correlations to earlier ones."""
        met = [(-abs(corr), self.members[name][1], self.members[name][2], self.members[name][0]) for name, corr in near if name in self.members]
        if not met:
            return "new_chain", record, self.add(record, record, seq, rank_ic), None
        _, place, best, head = min(met)
        if rank_ic is not None and rank_ic > self.bar[head]:
            return "extend", head, self.add(record, head, place, rank_ic), best
        return "reject_not_beating_chain", head, None, best


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (group, seq, record_id, rank_ic, near) sorted by group and seq -> decisions."""
    key, chains = None, Chains()
    for b in batches:
        out = []
        for group, seq, record, rank_ic, near in b[["group", "seq", "record_id", "rank_ic", "near"]].itertuples(index=False):
            if group != key:
                key, chains = group, Chains()
            rank_ic = None if pd.isna(rank_ic) else float(rank_ic)
            action, head, position, best = chains.decide(seq, record, rank_ic, [(x["name"], x["corr"]) for x in (near if near is not None else [])])
            out.append((seq, record, action, head, position, best, rank_ic))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")]).astype({"position": "Int32", "best_member_position": "Int32"})


def chain_updates(records: DataFrame, series: DataFrame, least: float = LEAST) -> DataFrame:
    """seq, record_id, action, chain, head, position, best_member_position, n_chains of records (seq, record_id, rank_ic) with their series.

    seq and record_id are distinct; chain is the number of the chain from 0 in order of their heads, n_chains how many
    there are after the decision. A record without a series begins a chain.
    """
    ship(records.sparkSession)
    records = saved(records.select(F.col("seq").cast("long").alias("seq"), F.col("record_id").cast("string").alias("record_id"), F.col("rank_ic").cast("double").alias("rank_ic")), "records")
    links = S.pairwise(series.withColumn("series_id", F.col("series_id").cast("string"))).where(F.abs("corr") >= least)
    place = records.select("record_id", "seq")
    links = links.join(place.toDF("a", "sa"), "a").join(place.toDF("b", "sb"), "b")
    links = saved(links.select("a", "b", "corr", "sa", "sb"), "links")
    # Each link belongs to its later record.
    later = F.col("sa") > F.col("sb")
    near = links.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("record_id"), F.struct(F.when(later, F.col("b")).otherwise(F.col("a")).alias("name"), "corr").alias("x"))
    near = near.groupBy("record_id").agg(F.collect_list("x").alias("near"))
    of = groups(links).select(F.col("node").alias("record_id"), "group")
    rows = records.join(near, "record_id", "left").join(of, "record_id", "left").withColumn("group", F.coalesce("group", "record_id"))
    decided = saved(rows.repartition("group").sortWithinPartitions("group", "seq").mapInPandas(_folded, DECIDED), "decided")
    counted = running_total(decided, "seq", F.col("action") == "new_chain", "n_chains")
    heads = counted.where("action = 'new_chain'").select(F.col("record_id").alias("head"), (F.col("n_chains") - 1).alias("chain"))
    return counted.join(heads, "head").select("seq", "record_id", "action", "chain", "head", "position", "best_member_position", "n_chains", "rank_ic")


def chains_of(updates: DataFrame) -> DataFrame:
    """chain, length, head, tail, best_rank_ic of every chain; a missing rank_ic counts as 0."""
    members = updates.where("position IS NOT NULL")
    return members.groupBy("chain").agg(F.count("*").alias("length"), F.min_by("record_id", "position").alias("head"), F.max_by("record_id", "position").alias("tail"), F.max(F.coalesce("rank_ic", F.lit(0.0))).alias("best_rank_ic"))
