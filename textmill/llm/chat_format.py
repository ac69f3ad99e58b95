"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialise, table

#: How a turn is rendered; {role} and {text} are replaced.
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _turns(df: DataFrame) -> DataFrame:
    """Distinct turns with nulls as 0 or ""; a conversation is ordered by turn, then role, then text.

    lone keeps turns without a conv_id apart: each is a conversation of its own.
    """
    turns = df.select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return turns.withColumn("lone", F.when(F.col("conv_id").isNull(), F.sha2(F.concat_ws("\x1f", F.col("turn").cast("string"), "role", "text"), 256)))


def prefix_hashes(df: DataFrame) -> DataFrame:
    """(conv_id, lone, prefixes): the rolling hash after each turn, the last one covering the whole conversation.

    Only a turn's digest travels, not its text. h_0 = "", h_k = sha256(h_(k-1) || sha256(role || 0x1F || text)).
    """
    slim = _turns(df).select("conv_id", "lone", F.struct("turn", "role", "text").alias("at"), F.sha2(F.concat_ws("\x1f", "role", "text"), 256).alias("digest"))
    slim = slim.select("conv_id", "lone", F.col("at.turn").alias("turn"), F.col("at.role").alias("role"), F.sha2(F.col("at.text"), 256).alias("tie"), "digest")
    turns = slim.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "tie", "digest"))).alias("turns"))
    rolled = F.aggregate("turns", F.array().cast("array<string>"), lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), t["digest"]), 256))))
    return turns.select("conv_id", "lone", rolled.alias("prefixes"))


def maximal_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, lone, n_turns, n_logged): conversations that are no prefix of a longer one; of equal ones the smallest id.

    n_logged counts the conversations logged with exactly these turns. Equal conversations and equal prefixes are
    merged by partial aggregation before the anti-join, so a first turn that a third of all logs share is one row.
    """
    hashes = materialise(prefix_hashes(df))
    whole = hashes.groupBy(F.element_at("prefixes", -1).alias("h")).agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "lone")).alias("best"), F.first(F.size("prefixes")).alias("n_turns"), F.count("*").alias("n_logged"))
    starts = hashes.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("h")).distinct()
    return whole.join(starts, "h", "left_anti").select("best.conv_id", "best.lone", F.col("n_turns").cast("long").alias("n_turns"), "n_logged")


def rendered(turns: Column, template: str = TURN) -> Column:
    """The turns of an array of structs (role, text) as one string. Template marks inside a text are broken up."""
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(head), clean(t["role"]), F.lit(middle), clean(t["text"]), F.lit(tail))), "")


def format_chats(df: DataFrame, template: str = TURN) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_logged, text (the rendered conversation).

    Input: conv_id, turn, role, text; other columns are ignored. Null turns count as 0, null roles and texts as "";
    a row with a null conv_id is a conversation of its own. Repeated rows count once; equal turn numbers are ordered by role,
    then by the text's digest. Texts are shuffled once, and only those of retained conversations are gathered.
    """
    best = maximal_conversations(df)
    turns = _turns(df).withColumn("tie", F.sha2("text", 256))
    kept = turns.join(best.select(F.col("conv_id").alias("kept_id"), F.col("lone").alias("kept_lone"), "n_turns", "n_logged"), F.col("conv_id").eqNullSafe(F.col("kept_id")) & F.col("lone").eqNullSafe(F.col("kept_lone")))
    whole = kept.groupBy("conv_id", "lone", "n_turns", "n_logged").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "tie", "text"))).alias("turns"))
    return whole.select("conv_id", "n_turns", "n_logged", rendered(F.col("turns"), template).alias("text"))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """Maximal conversations of the table, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    return """
with t as (select distinct conv_id, coalesce(turn, 0) turn, coalesce(role, '') role, coalesce(text, '') text from conversations),
c as (select conv_id, case when conv_id is null then sha256(concat_ws(chr(31), turn, role, text)) end lone, list(role || chr(31) || text order by turn, role, sha256(text)) turns,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by turn, role, sha256(text)) body from t group by 1, 2),
w as (select turns, body, min(conv_id) conv_id, count(*) n_logged from c group by 1, 2),
p as (select distinct list_slice(turns, 1, k) turns from (select turns, unnest(range(1, len(turns))) k from w))
select conv_id, len(turns)::bigint n_turns, n_logged, body as text from w where turns not in (select turns from p)"""
