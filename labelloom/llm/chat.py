"""Operator 6, chat formatting by prefix-target expansion.

Native: DataFrame functions only. Every assistant turn becomes an example of its own: all turns before
it are context and only its text is trainable. What follows the last assistant turn stands in one more
row without a target, so that the output holds every conversation whole.

A turn is written ``<s>[role] text</s>``. Inside roles and texts the signs that control strings are made
of, and the escape sign itself, are each followed by a backslash, which no control string contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: The text that the extra conversation holds in both of its turns.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<>\[\]\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<>\[\]\\])\\", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, target (whether it has one), text, loss_start (1-based), loss_length: code points of ``text`` under the mask.

    Turns are ordered by turn, then role and text; null turns come first. A null role or text is empty. Rows
    without conv_id are one conversation. An empty table gives no rows. Other columns are not read. An example
    holds its whole context, so a conversation is a value of one row and must fit there, as in any such format.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("] "))
    body = escape(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    made = said.select("conv_id", F.row_number().over(order).alias("seq"), (F.col("role") == "assistant").alias("reply"), F.length(head).alias("n_head"), F.length(body).alias("n_body"), F.concat(head, body, F.lit("</s>")).alias("said"))
    end = F.sum(F.col("n_head") + F.col("n_body") + 4).over(Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    turn = F.struct("seq", "reply", "n_body", end.cast("int").alias("end"), "said")
    whole = made.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    target = F.filter("t", lambda x: x["reply"] | (x["seq"] == F.size("t")))
    row = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["said"]), "").alias("all"), F.posexplode(F.transform(target, lambda x: x.dropFields("said"))).alias("example", "x"))
    loss = F.when(F.col("x.reply"), F.col("x.n_body")).otherwise(0)
    return row.select("conv_id", "example", F.col("x.reply").alias("target"), F.substring("all", F.lit(1), F.col("x.end")).alias("text"), (F.col("x.end") - 3 - loss).alias("loss_start"), loss.alias("loss_length"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows of a conversation say: its turns from the last row, the trained text from all masks."""
    masked = F.expr("substring(text, loss_start, loss_length)")
    last = F.max_by("text", "example")
    by_conv = formatted.groupBy("conv_id").agg(
        last.alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", masked.alias("m")))), lambda x: x["m"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    turns = F.regexp_extract_all("whole", F.lit(r"(?s)<s>\[.*?\] .*?</s>"), F.lit(0))
    part = lambda k: lambda t: unescape(F.regexp_extract(t, r"(?s)^<s>\[(.*?)\] (.*)</s>$", k))
    told = F.transform(turns, lambda t: F.concat(part(1)(t), F.lit("\n"), part(2)(t), F.lit("\n")))
    loss = unescape(F.col("loss"))
    return by_conv.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(written(examples(chats.unionByName(probe)), "chat"))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq, count(*) OVER (PARTITION BY conv_id) AS n,
  10 + length(role) + length(text) + length(regexp_replace(role || text, '[^<>\[\]\\]', '', 'g')) AS k FROM c),
e AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY seq) AS ends FROM f)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR seq = n THEN ends ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
