"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is
rendered once, as the prompt; what follows in each is its completion. Loss spans mark
what a trainer may learn from: the assistant's text with its end mark. All of it is
Column expressions over two arrays of turns a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table

HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(BODY))


def render(turns: Column) -> Column:
    """Text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def loss_spans(turns: Column, learned: str = LEARNED) -> Column:
    """array<struct<start, end>>: characters of render(turns) that are not masked."""
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["pos"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END)
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("pos"), F.when(t["role"] == learned, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, prefix_turns, prompt, chosen, rejected (strings), chosen_spans, rejected_spans.

    `pair` names the pair of a row and `chosen` says on which side it stands. Turns are
    ordered by number, then role and text (a null number first); turns are equal if role
    and text are. A null role or text counts as empty. Rows with a null pair or side
    belong to no pair. A side without turns has a null completion and no spans, and then
    the prompt is empty; equal conversations have empty completions. A repeated row is a
    turn of its own; texts are rendered whole, however long; an empty table gives no rows. Other columns, whatever their names, are
    ignored. A row of the result holds one pair: its size is that of two conversations.
    """
    rows = turns.select(
        pair.alias("pair_id"), chosen.alias("side"), F.struct(F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t")
    ).where(F.col("pair_id").isNotNull() & F.col("side").isNotNull())
    plain = lambda c: F.transform(F.array_sort(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = rows.groupBy("pair_id").agg(F.collect_list(F.when(F.col("side"), F.col("t"))).alias("c"), F.collect_list(F.when(~F.col("side"), F.col("t"))).alias("r"))
    both = both.select("pair_id", plain(F.col("c")).alias("c"), plain(F.col("r")).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.sequence(F.lit(1), least), lambda i: ~F.element_at("c", i).eqNullSafe(F.element_at("r", i)))
    prefix = F.when(least == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, least))
    both = both.withColumn("p", prefix)
    rest = lambda c: F.slice(F.col(c), F.col("p") + 1, F.greatest(F.size(c) - F.col("p"), F.lit(0)))
    done = lambda c: F.when(F.size(c) > 0, render(rest(c)))
    return both.select(
        "pair_id",
        F.col("p").cast("bigint").alias("prefix_turns"),
        render(F.slice("c", F.lit(1), F.col("p"))).alias("prompt"),
        done("c").alias("chosen"),
        done("r").alias("rejected"),
        loss_spans(rest("c")).alias("chosen_spans"),
        loss_spans(rest("r")).alias("rejected_spans"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are pair k. Spans are written as start-end, comma-joined."""
    found = format_preferences(table(spark, sf_dir, "conversations"), F.floor(F.col("conv_id") / 2).cast("bigint"), F.pmod("conv_id", F.lit(2)) == 0)
    for c in ("chosen_spans", "rejected_spans"):
        found = found.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","))
    return found


SQL = f"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY 1),
bad AS (SELECT a.pair_id, min(a.i) AS i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
        WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1),
p AS (SELECT pair_id, nc, nr, coalesce(bad.i - 1, least(nc, nr)) AS p FROM n LEFT JOIN bad USING (pair_id)),
s AS (SELECT t.*, p.p, '{HEAD}' || role || '{BODY.strip()}' || chr(10) AS head FROM t JOIN p USING (pair_id)),
l AS (SELECT *, length(head) + length(text) + {len(END)} AS len FROM s),
o AS (SELECT *, sum(len) OVER (PARTITION BY pair_id, side ORDER BY i) - len AS pos FROM l WHERE i > p),
pr AS (SELECT pair_id, string_agg(head || text || '{END.strip()}' || chr(10), '' ORDER BY i) AS prompt FROM l WHERE i <= p AND side = 0 GROUP BY 1),
co AS (SELECT pair_id, side, string_agg(head || text || '{END.strip()}' || chr(10), '' ORDER BY i) AS body,
  string_agg(CAST(pos + length(head) AS BIGINT)::VARCHAR || '-' || CAST(pos + len AS BIGINT)::VARCHAR, ',' ORDER BY i) FILTER (role = '{LEARNED}') AS spans FROM o GROUP BY 1, 2)
SELECT p.pair_id, CAST(p AS BIGINT) AS prefix_turns, coalesce(prompt, '') AS prompt,
  CASE WHEN nc > 0 THEN coalesce(c.body, '') END AS chosen, CASE WHEN nr > 0 THEN coalesce(r.body, '') END AS rejected,
  coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM p LEFT JOIN pr USING (pair_id) LEFT JOIN co c ON c.pair_id = p.pair_id AND c.side = 0 LEFT JOIN co r ON r.pair_id = p.pair_id AND r.side = 1"""
