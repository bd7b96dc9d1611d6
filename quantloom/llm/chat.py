"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut at turns: the prefix sum of the tokens before a turn, divided by STEP, tells
its span. Every span is written as one window of text: the system turn, then as many last turns of
the span before as fit into HISTORY tokens, then the span's own turns. With a system turn of S tokens
and turns of T tokens at most, a window has at most S + HISTORY + STEP + T - 1 tokens. Turns that are
written again are context: the loss mask covers each assistant text once, in the window of its span.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and roles lose
their first character to an escape; a backslash becomes ``\\b``; so every text can be read back exactly.

Defined results: null texts and roles count as empty; turns with equal numbers are ordered by role and
text, null numbers come first; only a first turn with the role ``system`` is retained; a null conv_id
is a conversation of its own; repeated rows are turns of their own; an empty table gives no rows;
other columns are ignored. A token here is a run of word characters or another visible character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
STEP, HISTORY = 256, 96
TOKEN = r"\w+|[^\w\s]"
#: Control strings of this and other templates, by their first character and the rest of them.
ANGLE, SQUARE = r"<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)", r"\[(?=/?INST\])"


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(F.regexp_replace(x, ANGLE, r"\\l"), SQUARE, r"\\i")


def unescape(x: Column) -> Column:
    x = F.replace(F.replace(x, F.lit("\\i"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(x, F.lit("\\b"), F.lit("\\"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\n"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("\\n"), F.lit("\n")))


def windows(turns: DataFrame, step: int = STEP, history: int = HISTORY) -> DataFrame:
    """conv_id, span, formatted, mask (start and length of loss spans, in code points), n_repeated (turns of context written again)."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(order))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    t = t.withColumn("system", system).withColumn("tokens", F.when(system, 0).otherwise(F.regexp_count("text", F.lit(TOKEN))).cast("long"))
    before = F.sum("tokens").over(conv.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    t = t.withColumn("before", before)
    t = t.withColumn("span", F.dense_rank().over(conv.orderBy(F.floor(F.col("before") / step))) - 1)
    t = t.withColumn("last", F.max("span").over(conv)).withColumn("end", F.max(F.col("before") + F.col("tokens")).over(Window.partitionBy("conv_id", "span")))
    again = (
        F.when(F.col("system") & (F.col("last") > 0), F.sequence(F.lit(1), F.col("last")))
        .when(~F.col("system") & (F.col("span") < F.col("last")) & (F.col("end") - F.col("before") <= history), F.array(F.col("span") + 1))
        .otherwise(F.array().cast("array<int>"))
    )
    own = F.array(F.struct(F.col("span").alias("span"), F.lit(False).alias("again")))
    places = F.concat(own, F.transform(again, lambda s: F.struct(s.alias("span"), F.lit(True).alias("again"))))
    t = t.select("conv_id", "pos", "role", F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), F.explode(places).alias("place"))
    t = t.select("*", "place.span", "place.again").withColumn("length", F.length("head") + F.length("body") + len(END))
    start = F.sum("length").over(Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length") + F.length("head")
    loss = F.when((F.col("role") == "assistant") & ~F.col("again"), F.struct(start.cast("int").alias("start"), F.length("body").alias("length")))
    t = t.withColumn("loss", loss)
    parts = F.array_sort(F.collect_list(F.struct("pos", "head", "body", "loss")))
    w = t.groupBy("conv_id", "span").agg(parts.alias("parts"), F.count_if("again").alias("n_repeated"))
    return w.select(
        "conv_id",
        "span",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p["loss"]), lambda x: x.isNotNull()).alias("mask"),
        "n_repeated",
    )


def read_back(w: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; each once), losses (texts under the mask) and formatted_chars of the windows of each conversation."""
    turn = lambda x: F.struct(
        unescape_role(F.substring_index(F.substr(x, F.lit(len(BEGIN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(x, F.lit(len(BEGIN) + 2) + F.length(F.substring_index(F.substr(x, F.lit(len(BEGIN) + 1)), "\n", 1)))).alias("text"),
    )
    found = F.split("formatted", r"<\|im_end\|>\n")
    own = F.slice(found, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(found) - 1 - F.col("n_repeated").cast("int"), F.lit(0)))
    # The retained system turn of a later window comes first, and so is among the repeated ones.
    w = w.select(
        "conv_id",
        "span",
        F.transform(own, turn).alias("turns"),
        F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"]))).alias("losses"),
        F.length("formatted").cast("long").alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("span", "turns", "losses")))
    w = w.groupBy("conv_id").agg(ordered.alias("w"), F.sum("chars").alias("formatted_chars"))
    return w.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["losses"])).alias("losses"), "formatted_chars")


def digests(turns: DataFrame, step: int = STEP, history: int = HISTORY) -> DataFrame:
    back = read_back(windows(turns, step, history))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digests(turns.unionByName(extra))


ORACLE = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM raw
), counted AS (
  SELECT *, pos = 1 AND role = 'system' AS system,
    CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE len(regexp_extract_all(text, '\w+|[^\w\s]')) END AS tokens,
    length(role) + {len(BEGIN) + 1 + len(END)} + length(regexp_replace(regexp_replace(replace(text, '\', '\b'),
      '<(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)', '\\l\1', 'g'), '\[(/?INST\])', '\\i\1', 'g')) AS size
  FROM numbered
), summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS before FROM counted
), spans AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY before // {STEP}) - 1 AS span FROM summed
), placed AS (
  SELECT *, max(span) OVER (PARTITION BY conv_id) AS last, max(before + tokens) OVER (PARTITION BY conv_id, span) AS finish FROM spans
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(size * (1 + CASE WHEN system THEN last WHEN span < last AND finish - before <= {HISTORY} THEN 1 ELSE 0 END)) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
