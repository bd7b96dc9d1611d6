"""Catalog, trace, audit, job, campaign and wiki operators over record tables."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.structure import described
from quantloom.session import saved

# Keys whose values are secret, and the metrics that a slim record keeps.
SECRET_KEYS = ["api_key", "password", "token", "authorization", "secret", "llm_api_key"]
METRIC_KEYS = ["ic", "rank_ic", "sharpe", "turnover", "max_drawdown", "annual"]


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (source, source_ref, id, created_at, updated_at, …) where new replaces old on (source, source_ref), but for id and created_at.

    Of new rows with one key the last updated counts, of those the one with the largest id.
    """
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rest = [c for c in old.columns if c not in ("source", "source_ref", "id", "created_at")]
    first, last = F.struct("_age", "created_at", "id"), F.struct("_age", "updated_at", "id")
    return both.groupBy("source", "source_ref").agg(F.min_by("id", first).alias("id"), F.min_by("created_at", first).alias("created_at"), *(F.max_by(c, last).alias(c) for c in rest))


def search(catalog: DataFrame, text: str | None = None, limit: int = 50, **equal: str) -> DataFrame:
    """Newest first: name, formula or second name (those there are) contain the text in any case; other columns are equal."""
    for c, v in equal.items():
        catalog = catalog.where(F.col(c) == v)
    if text:
        pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        found = [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in ("name", "formula", "name_cn") if c in catalog.columns]
        catalog = catalog.where(reduce(or_, found, F.lit(False)))
    return catalog.orderBy(F.desc("updated_at"), "id").limit(limit)


def search_or(catalog: DataFrame, library: DataFrame, text: str | None = None, limit: int = 50, **equal: str) -> DataFrame:
    """The search in the catalog, and only if nothing is found there, that in the library; `origin` tells which. Both are searched in one job."""
    found = search(catalog, text, limit, **equal).withColumn("origin", F.lit("catalog"))
    other = search(library, text, limit, **equal).withColumn("origin", F.lit("library"))
    some = found.agg(F.count("*").alias("some"))  # one row
    return found.unionByName(other.crossJoin(F.broadcast(some)).where("some = 0").drop("some"))


def with_expr_hash(catalog: DataFrame, column: str = "expr") -> DataFrame:
    """catalog with expr_hash, the coarse hash of its expressions, null where one doesn't parse; each distinct expression is parsed once."""
    known = described(catalog.select(F.col(column).alias("expr"))).select(F.col("expr").alias(column), F.col("hash").alias("expr_hash"))
    return catalog.join(known, column, "left")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, int, int | None]:
    """The page, the total, and the next offset or None; offset is 0 at least, limit 1 to 200."""
    offset, limit = max(0, offset), min(200, max(1, limit))
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(limit), total, offset + limit if offset + limit < total else None


def with_parent(events: DataFrame, chain: list[str], order: list[str]) -> DataFrame:
    """Each event's parent is the one before it in its chain."""
    return events.withColumn("parent_id", F.lag("id").over(Window.partitionBy(*chain).orderBy(*order)))


def audit_breaks(log: DataFrame) -> DataFrame:
    """log (chain, seq, hash, prev_hash) with linked: whether prev_hash is the hash before; an empty one is tolerated."""
    before = F.lag("hash").over(Window.partitionBy("chain").orderBy("seq"))
    return log.withColumn("linked", F.coalesce(F.col("prev_hash") == before, F.lit(True)) | (F.coalesce("prev_hash", F.lit("")) == ""))


def redacted(m: Column) -> Column:
    """Values of secret keys in a map become ***."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(SECRET_KEYS), "***").otherwise(v))


def _without_secrets(x):
    if isinstance(x, dict):
        return {k: "***" if k.lower() in SECRET_KEYS else _without_secrets(v) for k, v in x.items()}
    return [_without_secrets(v) for v in x] if isinstance(x, list) else x


def _redact(detail: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else json.dumps(_without_secrets(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    return detail.map(one)


def redacted_json(detail: Column) -> Column:
    """Values of secret keys at any depth of a JSON document become "***"; what is no JSON stays.

    Documents nest without a bound, which no built-in function follows, so this one is a Pandas function.
    """
    return F.pandas_udf(_redact, "string")(detail)


def slim_metrics(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(METRIC_KEYS))


def error_key(e: Column) -> Column:
    return F.lower(F.trim(F.split_part(e, F.lit(":"), F.lit(1))))


def same_error(a: Column, b: Column) -> Column:
    """Either key begins with the other."""
    return F.startswith(error_key(a), error_key(b)) | F.startswith(error_key(b), error_key(a))


def error_kin(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (e, key) of distinct strings e, and kin (key, longer): the distinct keys that begin with another, and each with itself.

    A key meets the keys among its own beginnings, of the lengths that keys have, by number and hash of the beginning; so no
    two strings of one group are paired, and no text travels more often than there are pairs.
    """
    members = errors.select("e", error_key(F.col("e")).alias("key")).distinct()
    keys = saved(members.select("key").distinct().withColumn("id", F.monotonically_increasing_id()), "keys")
    lengths = keys.agg(F.collect_set(F.length("key")).alias("lengths"))
    held = keys.crossJoin(F.broadcast(lengths))  # one row, a number for each length that occurs
    starts = held.select(F.col("id").alias("longer_id"), "key", F.explode(F.filter("lengths", lambda n: n <= F.length("key"))).alias("n"))
    starts = starts.select("longer_id", "n", F.xxhash64(F.substring(F.col("key"), F.lit(1), F.col("n"))).alias("h"))
    pairs = starts.join(keys.select("id", F.length("key").alias("n"), F.xxhash64("key").alias("h")), ["n", "h"]).select("id", "longer_id")
    pairs = saved(pairs, "kin").join(keys, "id").join(keys.select(F.col("id").alias("longer_id"), F.col("key").alias("longer")), "longer_id")
    return members, pairs.where(F.startswith("longer", F.col("key"))).select("key", "longer")


def error_pairs(errors: DataFrame) -> DataFrame:
    """a, b with a < b: the distinct strings e of which one's key begins with the other's."""
    members, kin = error_kin(errors)
    both = kin.join(members.withColumnRenamed("e", "x"), "key").join(members.select(F.col("e").alias("y"), F.col("key").alias("longer")), "longer")
    both = both.where((F.col("key") != F.col("longer")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


LAST_ERRORS = 80


def similar_errors(events: DataFrame, error: str, last: int = LAST_ERRORS) -> DataFrame:
    """Of the last events with an error (ts, event_id, error), those whose key is akin to that of the given one; newest first."""
    recent = events.where(F.col("error").isNotNull()).orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    return recent.where(same_error(F.col("error"), F.lit(error))).orderBy(F.desc("ts"), F.desc("event_id"))


FOLD_ROWS = 4096


def clamped_weights(log: DataFrame, low: float = -10.0, high: float = 10.0) -> DataFrame:
    """signature, weight, attempts, survived of a log (signature, seq, survived): +2 or -1 each, clamped after every step.

    Steps compose: any run of them is x -> min(b, max(a, x + s)). So the ordered log of a signature is
    folded in stretches of FOLD_ROWS, each to three numbers, and these are folded again; no row ever
    holds a whole log.
    """
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    order = Window.partitionBy("signature").orderBy("seq")
    rows = log.select("signature", "seq", "survived", F.when(F.col("survived"), 2.0).otherwise(-1.0).alias("step"))
    rows = rows.withColumn("stretch", F.floor((F.row_number().over(order) - 1) / FOLD_ROWS))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b"))
    step = lambda acc, x: F.struct((acc["s"] + x["step"]).alias("s"), clamp(acc["a"] + x["step"]).alias("a"), clamp(acc["b"] + x["step"]).alias("b"))
    run = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "step"))), start, step)
    runs = rows.groupBy("signature", "stretch").agg(run.alias("run"), F.count("*").alias("attempts"), F.count_if("survived").alias("survived"))
    weight = F.aggregate(F.array_sort(F.collect_list(F.struct("stretch", "run"))), F.lit(0.0), lambda acc, x: F.greatest(x["run"]["a"], F.least(x["run"]["b"], acc + x["run"]["s"])))
    return runs.groupBy("signature").agg(weight.alias("weight"), F.sum("attempts").alias("attempts"), F.sum("survived").alias("survived"))


def outcome(found: Column, status: Column, factors: Column, error: Column) -> Column:
    """struct(state, catalog_ids, error) of one result of a campaign.

    found: whether there is a result; factors: array of structs with catalog_id and id, of which the
    first that is set names the entry. Nothing found fails as empty_result; no factors under an empty
    or ok status say from which; an error fails with its first 300 characters.
    """
    status = F.coalesce(status, F.lit(""))
    none = F.coalesce(F.size(factors), F.lit(0)) <= 0
    set_ = lambda x: F.nullif(x.cast("string"), F.lit(""))
    ids = F.array_compact(F.transform(F.coalesce(factors, F.array().cast("array<struct<catalog_id:string,id:string>>")), lambda f: F.coalesce(set_(f["catalog_id"]), set_(f["id"]))))
    made = lambda state, ids, error: F.struct(F.lit(state).alias("state"), ids.alias("catalog_ids"), error.alias("error"))
    nothing, no_error = F.array().cast("array<string>"), F.lit(None).cast("string")
    return (
        F.when(~F.coalesce(found, F.lit(False)), made("failed", nothing, F.lit("empty_result")))
        .when(status == "no_factors", made("no_factors", nothing, no_error))
        .when(status.isin("", "ok") & none, made("no_factors", nothing, F.concat(F.lit("no_factors_from:"), F.when(status == "", "unknown").otherwise(status))))
        .when(F.coalesce(F.trim(error), F.lit("")) != "", made("failed", nothing, F.substring(error, 1, 300)))
        .when(F.size(ids) == 0, made("no_factors", nothing, no_error))
        .otherwise(made("done", ids, no_error))
    )


# What a run is called whose job is in a given state; other states keep their names.
RUN_STATES = {"queued": "pending", "running": "running", "done": "completed", "error": "failed", "cancelled": "stopped"}


def run_status(state: Column) -> Column:
    """Of a job's state; without one, pending."""
    known = F.create_map(*[F.lit(x) for pair in RUN_STATES.items() for x in pair])
    state = F.coalesce(F.nullif(state, F.lit("")), F.lit("pending"))
    return F.coalesce(F.try_element_at(known, state), state)


def run_of_job(status: Column, updated_at: Column) -> dict[str, Column]:
    """status, is_active and ended_at of the run of a job."""
    mapped = run_status(status)
    return {"status": mapped, "is_active": mapped.isin("pending", "running", "starting"), "ended_at": F.when(mapped.isin("completed", "failed", "stopped"), updated_at)}


def wiki_issues(pages: DataFrame, now: Column, stale_days: int = 90) -> DataFrame:
    """slug, issue of pages (slug, title, text, updated): missing_title, stale (not updated for stale_days, one at least, or never), missing_frontmatter."""
    old = F.coalesce(F.col("updated") < now - F.make_dt_interval(F.lit(max(1, stale_days))), F.lit(True))
    issues = F.array_compact(F.array(F.when(F.coalesce("title", F.lit("")) == "", "missing_title"), F.when(old, "stale"), F.when(~F.startswith(F.coalesce("text", F.lit("")), F.lit("---")), "missing_frontmatter")))
    return pages.select("slug", F.explode(issues).alias("issue"))


def recalled_motifs(motifs: DataFrame, error: str | None = None, limit: int = 5) -> DataFrame:
    """The motifs (signature, weight, error_prefix …) of the largest weight, of the class of an error if one is given; one at least is asked for."""
    head = lambda c: F.split_part(F.coalesce(c, F.lit("")), F.lit(":"), F.lit(1))
    found = motifs if not error else motifs.where(head(F.col("error_prefix")) == head(F.lit(error)))
    return found.orderBy(F.desc("weight"), "signature").limit(max(1, limit))


def wiki_edges(pages: DataFrame) -> DataFrame:
    """src, dst of [[slug]] links between known slugs of pages (slug, text)."""
    links = pages.select(F.col("slug").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([A-Za-z0-9_\-]+)\]\]"), 1))).alias("dst"))
    return links.join(pages.select(F.col("slug").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def first_by(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def accepted(rows: DataFrame, allow_incomplete: bool = False) -> DataFrame:
    """Ingest filter: pool rows need returns; library rows need metrics, and ic or returns unless incomplete ones are allowed."""
    pool = (F.col("kind") == "pool") & (F.col("n_returns") > 0)
    library = (F.col("kind") == "library") & F.col("has_metrics") & (F.lit(allow_incomplete) | F.col("ic").isNotNull() | (F.col("n_returns") > 0))
    return rows.where(pool | library)


def isolated_records(results: DataFrame) -> DataFrame:
    """Catalog rows of results (name, ok, expression, ic, n_returns) of user code that ran; ready for `upserted`.

    A result with an expression that was evaluated is real; one of code alone counts as simulated.
    """
    text = F.trim(F.coalesce("expression", F.lit("")))
    ref = F.concat(F.lit("iso_"), F.left(F.sha2("name", 256), F.lit(16)))
    fine = results.where("ok")
    return fine.select(
        F.lit("manual").alias("source"), ref.alias("source_ref"), F.concat(F.lit("fac_"), ref).alias("id"), "name",
        F.when(text != "", text).otherwise("compute(panel)").alias("formula"), F.when(text != "", "expression").otherwise("python").alias("dialect"),
        "ic", "n_returns", F.lit("candidate").alias("status"), ((text == "") | F.col("ic").isNull()).alias("is_simulated"), F.array(F.lit("isolated")).alias("tags"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )


def lessons(failures: DataFrame, error: str | None = None, limit: int = 5, most: int = 120) -> DataFrame:
    """event_id, error_head, summary, hypothesis of the newest failures (ts, event_id, error, summary, hypothesis), akin to an error if one is given."""
    found = failures.where("error IS NOT NULL")
    if error is not None:
        found = found.where(same_error(F.col("error"), F.lit(error)))
    summary = F.coalesce("summary", F.lit(""))
    short = F.when(F.length(summary) > most, F.concat(F.substring(summary, 1, most - 3), F.lit("..."))).otherwise(summary)
    return found.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("event_id", F.trim(F.split_part("error", F.lit(":"), F.lit(1))).alias("error_head"), short.alias("summary"), "hypothesis")


def research_context(samples: list, failures: DataFrame, chains: list, error: str | None = None, most: int = 5) -> dict:
    """Samples, lessons and chains in one block with their counts; a few of each."""
    found = [r.asDict() for r in lessons(failures, error, most).collect()]
    return {"samples": samples, "lessons": found, "chains": chains, "counts": {"samples": len(samples), "lessons": len(found), "chains": len(chains)}}
