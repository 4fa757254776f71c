"""Preference formatting: a shared prompt and a pair of masked completions. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One rendered turn; the role line opens it, the end mark closes it.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def plain(text: Column) -> Column:
    """Text whose ``<|`` cannot be read as a mark: a word joiner parts the two characters."""
    return F.replace(text, F.lit("<|"), F.lit("<\u2060|"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """The turns of chosen and rejected conversations, split into prompt and completions.

    ``turns`` has pair_id, side ('chosen' or 'rejected'), turn, role, text. Result:
    pair_id, part ('prompt', 'chosen', 'rejected'), turn, seg (rendered turn), head (characters of its role line) and loss
    (1 on assistant turns of a completion, else 0). Marks inside roles and texts are made plain, so that no turn can pretend to be another. The prompt is the longest prefix of
    turns that both sides share; it appears once, from the chosen side.

    The prefix length is an aggregate of per-turn comparisons: (pair, turn) groups
    meet both sides, and the least differing turn of a pair is a minimum with map-side
    combine; no pair is collected for it. Rows repeating (pair, side, turn) count as
    one turn of several messages, in the order of (role, text). Rows without pair_id,
    side or turn are of no conversation and left out; a null role reads 'unknown', a null
    text is empty.
    """
    rows = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')").select(
        "pair_id", "side", "turn", F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("msg")
    )
    met = rows.groupBy("pair_id", "turn").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "chosen", F.col("msg")))).alias("chosen"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "rejected", F.col("msg")))).alias("rejected"),
    )
    split = met.groupBy("pair_id").agg(F.min(F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))).alias("cut"))
    cut = met.join(split, "pair_id")
    in_prompt = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    parts = F.when(in_prompt, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("msgs")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("msgs")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("msgs")))
    )
    long = cut.select("pair_id", "turn", F.inline(parts)).select("pair_id", "turn", "part", F.posexplode("msgs").alias("at", "msg"))
    return long.select(
        "pair_id", "part", "turn", "at",
        F.concat(F.lit("<|"), plain(F.col("msg.role")), F.lit("|>\n"), plain(F.col("msg.text")), F.lit(CLOSE)).alias("seg"),
        (F.char_length(plain(F.col("msg.role"))) + 5).alias("head"),
        ((F.col("part") != "prompt") & (F.col("msg.role") == "assistant")).cast("int").alias("loss"),
    )


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair: prompt, prompt_turns, chosen, rejected and their loss masks.

    A mask is a list of character spans 'start-end' (end exclusive, comma-separated) of
    the completion that the loss counts: what its assistant turns say and their end marks, not the role lines.
    Conversations that are equal are a prompt with two empty completions. Long texts stay whole; other columns are ignored. A pair is one training
    sample, so its turns meet in one row; everything before works turn by turn. A pair
    with one side has an empty completion on the other; an empty table gives no rows.
    """
    segs = preference_segments(turns)
    per_part = segs.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "at", "seg", "head", "loss"))).alias("segs"), F.countDistinct("turn").alias("n"))
    text = F.array_join(F.transform("segs", lambda s: s["seg"]), "")
    spans = F.aggregate(
        "segs",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + F.char_length(s["seg"])).alias("at"),
            F.when(s["loss"] == 1, F.concat(acc["out"], F.array(F.concat((acc["at"] + s["head"]).cast("string"), F.lit("-"), (acc["at"] + F.char_length(s["seg"])).cast("string"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_join(acc["out"], ","),
    )
    rendered = per_part.select("pair_id", "part", "n", text.alias("text"), spans.alias("mask"))

    def of(part: str, col: str, default) -> Column:
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col(col))), F.lit(default))

    return rendered.groupBy("pair_id").agg(
        of("prompt", "text", "").alias("prompt"),
        of("prompt", "n", 0).cast("long").alias("prompt_turns"),
        of("chosen", "text", "").alias("chosen"),
        of("chosen", "mask", "").alias("chosen_mask"),
        of("rejected", "text", "").alias("rejected"),
        of("rejected", "mask", "").alias("rejected_mask"),
    )


def op10_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) of the whole table are a pair; rows without conv_id are of none."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sides = rows.select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        F.col("turn").cast("long").alias("turn"), "role", "text",
    )
    return format_preferences(sides)


OP10_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) >> 1 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (
  SELECT pair_id, turn,
         list_sort(coalesce(list({'role': role, 'text': text}) FILTER (side = 'chosen'), [])) AS chosen,
         list_sort(coalesce(list({'role': role, 'text': text}) FILTER (side = 'rejected'), [])) AS rejected
  FROM t GROUP BY ALL),
c AS (SELECT pair_id, min(turn) FILTER (chosen IS DISTINCT FROM rejected) AS cut FROM m GROUP BY pair_id),
s AS (
  SELECT m.pair_id, 'prompt' AS part, turn, unnest(chosen) AS msg FROM m JOIN c USING (pair_id) WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT m.pair_id, 'chosen', turn, unnest(chosen) FROM m JOIN c USING (pair_id) WHERE turn >= cut
  UNION ALL SELECT m.pair_id, 'rejected', turn, unnest(rejected) FROM m JOIN c USING (pair_id) WHERE turn >= cut),
r AS (
  SELECT pair_id, part, turn, '<|' || replace(msg.role, '<|', '<' || chr(8288) || '|') || '|>' || chr(10) || replace(msg.text, '<|', '<' || chr(8288) || '|') || '<|end|>' || chr(10) AS seg,
         length(replace(msg.role, '<|', '<' || chr(8288) || '|')) + 5 AS head,
         part <> 'prompt' AND msg.role = 'assistant' AS loss, msg
  FROM s),
p AS (
  SELECT *, sum(length(seg)) OVER (PARTITION BY pair_id, part ORDER BY turn, msg.role, msg.text ROWS UNBOUNDED PRECEDING) AS till FROM r),
g AS (
  SELECT pair_id, part, string_agg(seg, '' ORDER BY turn, msg.role, msg.text) AS text, count(DISTINCT turn) AS n,
         string_agg(CAST(till - length(seg) + head AS VARCHAR) || '-' || CAST(till AS VARCHAR), ',' ORDER BY till) FILTER (loss) AS mask
  FROM p GROUP BY pair_id, part)
SELECT pair_id,
       coalesce(max(text) FILTER (part = 'prompt'), '') AS prompt, coalesce(max(n) FILTER (part = 'prompt'), 0) AS prompt_turns,
       coalesce(max(text) FILTER (part = 'chosen'), '') AS chosen, coalesce(max(mask) FILTER (part = 'chosen'), '') AS chosen_mask,
       coalesce(max(text) FILTER (part = 'rejected'), '') AS rejected, coalesce(max(mask) FILTER (part = 'rejected'), '') AS rejected_mask
FROM g GROUP BY pair_id
"""
