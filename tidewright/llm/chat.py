"""Chat formatting of reply trees.

Pointers to parents are doubled by iterative self-joins, so a tree of depth d takes about log2(d) of them; the same
pointers then enumerate the messages of each chosen root-to-leaf path. Branches are ranked by mean score, then length,
then message id, and each chosen path becomes one conversation.

Template: each turn is <s>[INST]role[/INST]text</s>. In roles and texts a backslash becomes \\s, and the first
character of each of these four marks becomes \\l or \\b, so that no mark in a text can pass for the template's.

Defined results: a null text or role is empty. A message whose parent isn't there is a root. Messages on a cycle have no
root and are in no conversation. Conversation ids may be null and then form one conversation. Repeated message ids
within a conversation are an error of the input; linear() numbers rows itself, by turn, role and text, nulls first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
#: The conversation that shows the template's marks in texts.
MARKED = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(("\\l" if mark[0] == "<" else "\\b") + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def linear(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, msg, parent, role, text, score of a table of conversations without branches: each row answers the last."""
    nth = F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first()))
    out = rows.select(F.col(conv).alias("conv"), nth.cast("bigint").alias("msg"), F.col(role).alias("role"), F.col(text).alias("text"))
    return out.select("conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """conv, root, leaf, msg, place (1 for the root): the messages of the best `keep` branches under each root.
    messages: conv, msg, parent, score."""
    nodes = messages.select("conv", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("conv").alias("pc"), F.col("msg").alias("pm"))
    nodes = nodes.join(known, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("parent") == F.col("pm")), "left")
    start = nodes.select("conv", "msg", F.col("pm").alias("up"), F.lit(1).cast("bigint").alias("n"), F.col("score").alias("total"), F.when(F.col("pm").isNull(), F.col("msg")).alias("root"))
    # A level holds the messages that still had a pointer in the level before. Those whose pointer has passed their root
    # are done: only others look them up, so short conversations take part in few rounds.
    levels = [cut(start)]
    done = [levels[0].where("up IS NULL")]
    most = max(1, levels[0].count()).bit_length()
    while len(levels) <= most and levels[-1].where("up IS NOT NULL").limit(1).count():
        here = levels[-1].where("up IS NOT NULL")
        there = reduce(DataFrame.unionByName, done, here)
        there = there.select(F.col("conv").alias("oc"), F.col("msg").alias("om"), F.col("up").alias("ou"), F.col("n").alias("on"), F.col("total").alias("ot"), F.col("root").alias("oroot"))
        both = here.join(there, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("up") == F.col("om")))
        levels.append(cut(both.select("conv", "msg", F.col("ou").alias("up"), (F.col("n") + F.col("on")).alias("n"), (F.col("total") + F.col("ot")).alias("total"), F.coalesce("root", "oroot").alias("root"))))
        done.append(levels[-1].where("up IS NULL"))
    whole = reduce(DataFrame.unionByName, done).where("root IS NOT NULL")
    parents = levels[0].where("up IS NOT NULL").select(F.col("conv").alias("pc"), F.col("up").alias("pm"))
    leaves = whole.join(parents, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("msg") == F.col("pm")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv", "root").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "msg"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= keep).select("conv", "root", F.col("msg").alias("leaf"), "msg", F.col("n").alias("place"))
    out = cut(chosen)
    for k in range(len(levels) - 2, -1, -1):
        step = levels[k].where("up IS NOT NULL").select(F.col("conv").alias("pc"), F.col("msg").alias("pm"), "up")
        above = out.join(step, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("msg") == F.col("pm"))).select("conv", "root", "leaf", F.col("up").alias("msg"), (F.col("place") - 2**k).alias("place"))
        out = cut(out.unionByName(above))  # each round at most doubles the paths; without the cut, plans would too
    return out


def formatted(messages: DataFrame, keep: int = 1) -> DataFrame:
    """conv, root, leaf, formatted, loss (array of start and end, in code points, of the assistant texts as escaped).
    messages: conv, msg, parent, role, text, score."""
    texts = messages.select(F.col("conv").alias("mc"), F.col("msg").alias("mm"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths(messages, keep).join(texts, F.col("conv").eqNullSafe(F.col("mc")) & (F.col("msg") == F.col("mm")))
    turn = F.struct("place", (F.col("role") == "assistant").alias("loss"), F.concat(F.lit("<s>[INST]"), escaped(F.col("role")), F.lit("[/INST]")).alias("head"), escaped(F.col("text")).alias("body"))
    turns = rows.groupBy("conv", "root", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    string = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s, t):
        start = s["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        return F.struct((end + 4).alias("at"), F.when(t["loss"], F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["out"]).alias("out"))

    return turns.select("conv", "root", "leaf", string.alias("formatted"), F.aggregate("turns", zero, step, lambda s: s["out"]).alias("loss"))


def read_back(string: Column) -> Column:
    """The role and text of each turn of a formatted conversation."""
    parts = F.split(string, "</s>", -1)
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.split(F.substring(p, F.lit(10), F.length(p)), r"\[/INST\]", 2))
    return F.transform(inner, lambda p: F.struct(unescaped(F.get(p, F.lit(0))).alias("role"), unescaped(F.get(p, F.lit(1))).alias("text")))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    out = formatted(linear(rows.unionByName(extra)))
    back = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"]))), "")
    told = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size(back).cast("bigint").alias("n_turns"), F.sha2(F.encode(told, "utf-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(F.encode(loss, "utf-8"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\s')"
    for mark in MARKS:
        out = f"replace({out}, '{mark}', '{'\\l' if mark[0] == '<' else '\\b'}{mark[1:]}')"
    return out


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
