"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, its own text
alone is under the loss mask. A conversation that ends with another role gets one more example
without a target, so the output holds every turn. Control strings inside roles and texts are escaped
in a way that can be undone (& < [ become entities), so markers in the output are always markers.

Only DataFrame functions. A conversation is one row (its digest needs its whole text in order); the
examples of a row are built one at a time. A conversation of T turns has about T * T / 2 turns in its
examples, which is the method: 1,000 turns of 500 characters make 250 MB of examples.

Defined cases: null text and null role are empty; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows have a fixed order and are all kept; null conv_id is a conversation;
a conversation without an assistant has an empty loss; an empty table has only what is added to it;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, ROLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Escapes, in the order in which they are applied.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars); the loss mask is a range of code points."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    parts = ordered.select(
        "conv_id",
        F.transform("x", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(ROLE), escaped(t["text"]), F.lit(CLOSE))).alias("parts"),
        F.transform("x", lambda t: F.length(escaped(t["text"]))).alias("sizes"),
        F.transform("x", lambda t: t["role"] == "assistant").alias("target"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.element_at(F.col("target"), k) | (k == F.size("parts")))
    each = parts.withColumn("example", F.explode(ends))
    text = F.concat_ws("", F.slice("parts", 1, F.col("example")))
    own = F.when(F.element_at(F.col("target"), F.col("example")), F.element_at(F.col("sizes"), F.col("example"))).otherwise(0)
    out = each.select("conv_id", "example", text.alias("text"), own.alias("loss_chars"))
    return out.withColumn("loss_start", F.length("text") - len(CLOSE) - F.col("loss_chars"))


def read_back(output: DataFrame) -> DataFrame:
    """Digests of every conversation, from the examples alone."""
    loss = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars"))
    last = output.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_sort(F.collect_list(F.struct("example", unescaped(loss).alias("reply")))).alias("replies"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    turns = F.slice(F.split("text", CLOSE, -1), 1, F.size(F.split("text", CLOSE, -1)) - 1)
    told = F.transform(turns, lambda t: F.concat(unescaped(F.substring_index(F.substring(t, len(OPEN) + 1, 1 << 30), ROLE, 1)), F.lit("\n"), unescaped(F.substring_index(t, ROLE, -1)), F.lit("\n")))
    both = last.select("conv_id", told.alias("told"), F.concat_ws("", F.transform("replies", lambda r: r["reply"])).alias("loss"), "formatted_chars")
    return both.select(
        "conv_id",
        F.size("told").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", "told"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ADDED = "SELECT -1L AS conv_id, explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS x, '</s>[INST] ok [/INST]' AS text"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql(ADDED).select("conv_id", "x.turn", "x.role", "text")
    return read_back(examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    20 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) AS chars FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN prefix ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
