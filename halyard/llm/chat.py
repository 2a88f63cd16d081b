"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and all others as named
users; system turns stay system turns and have no perspective.  The mask is the character spans of the text that the
assistant is to learn: what the speaker says, with its closing tag.

A dialogue is rendered whole, up to `longest` turns; a longer one is cut, in its order, into parts of so many turns, the
last maybe shorter, and each part is rendered for those who speak in it.  So a rendering is of bounded size, and a
conversation that holds a third of all rows is many of them.  Turns of long conversations are numbered without one task
ordering them all: they are dealt to tasks by ranges of their order, and counts of ranges give each its place.  Offsets
are those in the part's own text.

Equal rows count once; rows of one turn number stand in order of role and text; null turns come last; a null role is the
speaker "unknown"; null text is empty; a row of null conv_id belongs to no known dialogue and is one of its own; a part
of system turns only has no perspective; tags inside a text are broken up by a space; an empty table gives an empty
result; columns besides these four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import materialize, table

#: Turns of a rendering at most.
LONGEST = 1024
#: So many characters of a text help to deal its row to a range; samples of that size go to the driver.
PREFIX = 1000
OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def cut(rows: DataFrame, longest: int) -> DataFrame:
    """rows of conversations that are too long, with the part of each by its place in the order."""
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("conv_id"), *order[:2], F.substring("text", 1, PREFIX)).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "chat-ranges")  # written at once, so that the number is final
    counts = dealt.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("conv_id").orderBy("_range")) - F.col("_size")  # a row for each range
    starts = counts.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_of"), before.alias("_start"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_nth", nth).join(starts, (F.col("conv_id") == F.col("_conv")) & (F.col("_range") == F.col("_of")))
    return placed.select(*rows.columns, F.floor((F.col("_start") + F.col("_nth")) / longest).cast("long").alias("part"))


def parts_of(rows: DataFrame, longest: int) -> DataFrame:
    """conv_id, part and turns, an array in order, of every part of every conversation."""
    one = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    lone = rows.filter(F.col("conv_id").isNull()).select("conv_id", F.lit(0).cast("long").alias("part"), F.array(one).alias("turns"))
    rows = rows.filter(F.col("conv_id").isNotNull())
    long = materialize(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > longest).select("conv_id"), "chat-long")
    placed = rows.withColumn("part", F.lit(0).cast("long"))
    if not long.isEmpty():
        placed = placed.join(long, "conv_id", "left_anti").unionByName(cut(rows.join(long, "conv_id", "left_semi"), longest))
    return placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(one)).alias("turns")).unionByName(lone)


def rotate(turns: DataFrame, *, longest: int = LONGEST) -> DataFrame:
    """conv_id, speaker, part, text, mask (start-end,start-end ... in characters), n_turns, n_own."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).distinct()
    speakers = F.array_except(F.transform("turns", lambda t: t["role"]), F.array(F.lit(SYSTEM)))  # each once
    views = parts_of(rows, longest).select("conv_id", "part", "turns", F.explode(speakers).alias("speaker"))

    def head(t: Column) -> Column:
        who = F.when(t["role"] == F.col("speaker"), "assistant").when(t["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(OPEN), who, F.lit("\n"))

    parts = F.transform("turns", lambda t: F.struct((t["role"] == F.col("speaker")).alias("own"), head(t).alias("head"), F.concat(t["text"], F.lit(f"{CLOSE}\n")).alias("body")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat_ws("-", begin.cast("string"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    views = views.withColumn("parts", parts)
    return views.select(
        "conv_id",
        "speaker",
        "part",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.array_join(F.aggregate("parts", start, step)["spans"], ",").alias("mask"),
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
    )


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


QUERIES = {"op5_perspectives": op5_perspectives}
ORACLE_SQL = {
    "op5_perspectives": f"""
with r as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as body from conversations),
q as (select *, case when conv_id is null then row_number() over (order by turn, role, body) end as lone from r),
n as (select *, (row_number() over (partition by conv_id, lone order by turn nulls last, role, body) - 1) // {LONGEST} as part from q),
s as (select distinct conv_id, lone, part, role as speaker from n where role <> '{SYSTEM}'),
p as (select n.conv_id, n.lone, n.part, s.speaker, n.turn, n.role, n.body,
  '{OPEN}' || case when n.role = s.speaker then 'assistant' when n.role = '{SYSTEM}' then '{SYSTEM}' else 'user name=' || n.role end || chr(10) as head,
  n.body || '{CLOSE}' || chr(10) as tail
  from n join s on n.conv_id is not distinct from s.conv_id and n.lone is not distinct from s.lone and n.part = s.part),
o as (select *, row_number() over w as k, cast(sum(length(head) + length(tail)) over w as bigint) as stop from p
  window w as (partition by conv_id, lone, speaker, part order by turn nulls last, role, body))
select conv_id, speaker, part, string_agg(head || tail, '' order by k) as text,
  coalesce(string_agg((stop - length(tail)) || '-' || (stop - 1), ',' order by k) filter (where role = speaker), '') as mask,
  count(*) as n_turns, count(*) filter (where role = speaker) as n_own
from o group by conv_id, lone, speaker, part""",
}
