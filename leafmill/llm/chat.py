"""Preference formatting: a pair of conversations becomes one prompt and two masked completions.

The prompt is the longest common turn prefix of the chosen and the rejected
conversation, rendered once; each completion is the rest, with character spans
that a loss should count (the assistant's words and their end mark).

Results in odd cases: turns sort by (turn, role, text), nulls first, and repeated
turns stay; a null role renders as 'unknown' and a null text as ''; a pair with one
side has the other completion empty and has_both false; equal conversations are
all prompt; a null pair id is a pair of its own; an empty table gives an empty
table.  Extra columns are not carried.  A pair is one output row, so its turns
meet in one task; a shuffle moves each turn once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _head(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """[start, end) characters of the rendered turns that belong to TRAINED_ROLE, as array<struct>."""
    empty = F.struct(F.lit(0).cast("int").alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        body = state["at"] + F.length(_head(t))
        done = body + F.length(t["text"]) + F.lit(len(END))
        one = F.array(F.struct(body.alias("start"), done.alias("end")))
        return F.struct((done + F.lit(1)).alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda state: state["spans"])


def preference_pairs(turns: DataFrame, pair: Column, rejected: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair id: prompt, chosen and rejected completions and their loss spans."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(rejected, F.lit(False)).alias("is_rejected"), one.alias("t"))
    # collect_list leaves out nulls, so each side gathers its own turns in the one shuffle.
    sides = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_rejected"), F.col("t")))).alias("chosen"),
        F.array_sort(F.collect_list(F.when(F.col("is_rejected"), F.col("t")))).alias("rejected"),
    )
    equal = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(F.col("equal"), False)
    sides = sides.withColumn("equal", equal).withColumn("n_prompt", F.when(first > 0, first - 1).otherwise(F.size("equal")).cast("int"))
    rest = {side: F.slice(F.col(side), F.col("n_prompt") + 1, F.greatest(F.size(side) - F.col("n_prompt"), F.lit(0))) for side in ("chosen", "rejected")}
    sides = sides.select("pair_id", "n_prompt", (F.size("chosen") * F.size("rejected") > 0).alias("has_both"), F.slice("chosen", F.lit(1), F.col("n_prompt")).alias("shared"), *[rest[s].alias(s) for s in rest])
    return sides.select(
        "pair_id", "has_both", F.col("n_prompt").alias("n_prompt_turns"), render(F.col("shared")).alias("prompt"),
        *[e for s in rest for e in (F.size(s).alias(f"n_{s}_turns"), render(F.col(s)).alias(s), loss_spans(F.col(s)).alias(f"{s}_loss"))],
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


_SIDE = """
  SELECT pair_id, {rej} AS side, string_agg(CASE WHEN k > n_prompt THEN shown END, '' ORDER BY k) AS body,
         string_agg(CASE WHEN k > n_prompt AND role = 'assistant' THEN
           (pos + length('<|im_start|>' || role) + 1) || '-' || (pos + length(shown) - 1) END, ',' ORDER BY k) AS loss,
         COUNT(*) FILTER (WHERE k > n_prompt) AS n
  FROM placed WHERE {cond} GROUP BY pair_id"""
ORACLE = f"""
WITH turns AS (
  SELECT conv_id >> 1 AS pair_id, COALESCE(conv_id % 2 = 1, false) AS rejected, turn,
         COALESCE(role, 'unknown') AS role, COALESCE(text, '') AS text FROM conversations),
numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, rejected ORDER BY turn NULLS FIRST, role, text) AS k,
         '{START}' || role || chr(10) || text || '{END}' || chr(10) AS shown FROM turns),
compared AS (
  SELECT COALESCE(a.pair_id, b.pair_id) AS pair_id, COALESCE(a.k, b.k) AS k,
         COALESCE(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM numbered WHERE NOT rejected) a FULL OUTER JOIN (SELECT * FROM numbered WHERE rejected) b
    ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.k = b.k),
prefix AS (
  SELECT pair_id, COALESCE(MIN(k) FILTER (WHERE NOT same) - 1, MAX(k)) AS n_prompt FROM compared GROUP BY pair_id),
joined AS (
  SELECT n.*, p.n_prompt FROM numbered n JOIN prefix p ON n.pair_id IS NOT DISTINCT FROM p.pair_id),
placed AS (
  SELECT *, COALESCE(SUM(CASE WHEN k > n_prompt THEN length(shown) ELSE 0 END) OVER (
    PARTITION BY pair_id, rejected ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM joined),
c AS ({_SIDE.format(rej="false", cond="NOT rejected")}),
r AS ({_SIDE.format(rej="true", cond="rejected")}),
shared AS (
  SELECT pair_id, string_agg(shown, '' ORDER BY k) AS prompt FROM placed WHERE k <= n_prompt AND NOT rejected GROUP BY pair_id)
SELECT p.pair_id, (c.side IS NOT NULL AND r.side IS NOT NULL) AS has_both, CAST(p.n_prompt AS INTEGER) AS n_prompt_turns,
       COALESCE(s.prompt, '') AS prompt, CAST(COALESCE(c.n, 0) AS INTEGER) AS n_chosen_turns, COALESCE(c.body, '') AS chosen,
       COALESCE(c.loss, '') AS chosen_loss, CAST(COALESCE(r.n, 0) AS INTEGER) AS n_rejected_turns,
       COALESCE(r.body, '') AS rejected, COALESCE(r.loss, '') AS rejected_loss
FROM prefix p LEFT JOIN c ON c.pair_id IS NOT DISTINCT FROM p.pair_id LEFT JOIN r ON r.pair_id IS NOT DISTINCT FROM p.pair_id
LEFT JOIN shared s ON s.pair_id IS NOT DISTINCT FROM p.pair_id
"""
