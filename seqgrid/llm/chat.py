"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that participant as the
assistant and everyone else as a user with a name; system turns stay system turns. The training
mask covers the assistant's texts and their end marks. The result is a row per turn and
perspective, with the place of its text and of its mask in the rendered dialogue, so a
conversation of any length is never held in one row; `render` joins short ones to strings.

A text can't forge a turn: of every `<` that only backslashes part from a `|`, one backslash more parts
them, so no control mark is left in it, and taking one away gives the text back (`unescaped`). Names are
escaped likewise, and their line breaks become spaces, so a name stays in the turn's first line.

Places are running sums over a conversation's turns in two levels (blocks of BLOCK places in turn
order, then turns of a block), so that a conversation with most of the rows is spread.

Nulls, ties and edges: a null role is the participant "unknown", a null text is empty, a null
turn sorts first and a null conv_id is a conversation of its own; equal turns are ordered by role
and text, repeated rows are turns of their own; a conversation without a participant other than
the system has no perspective; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqgrid.llm.common import table

START, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
BLOCK = 256


def escaped(text: Column) -> Column:
    """The text without control marks."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """What `escaped` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn_ix, turn, speaker, role, content, seg_from, seg_to, mask_from, mask_to)."""
    role = F.coalesce(F.trim("role"), F.lit("unknown"))
    t = turns.select("conv_id", "turn", role.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = t.where("speaker != 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    people = people.withColumnRenamed("conv_id", "_conv")
    t = t.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / F.lit(BLOCK)))
    spread = W.partitionBy("conv_id", "block")
    order = spread.orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    t = t.withColumn("ix", F.count("*").over(order))
    t = t.join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    t = t.withColumn("turn_ix", F.col("ix") + F.col("skip")).drop("ix", "skip")
    both = t.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    mine = F.col("speaker") == F.col("perspective")
    name = escaped(F.translate("speaker", "\r\n", "  "))
    label = F.when(F.col("speaker") == "system", F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    head = F.concat(F.lit(START), label, F.lit(MIDDLE))
    both = both.select(
        "conv_id", "perspective", "turn_ix", "turn", "speaker", "block", label.alias("role"),
        F.concat(head, escaped(F.col("text")), F.lit(STOP)).alias("content"), F.length(head).cast("long").alias("head"), mine.alias("mine"),
    )
    key = ["conv_id", "perspective", "block"]
    here = W.partitionBy(*key).orderBy("turn_ix").rowsBetween(W.unboundedPreceding, 0)
    lengths = both.groupBy(*key).agg(F.sum(F.length("content")).cast("long").alias("len"))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    lengths = lengths.select(*[F.col(k).alias(f"_{k}") for k in key], F.coalesce(F.sum("len").over(before), F.lit(0)).alias("skip"))
    both = both.withColumn("run", F.sum(F.length("content")).over(here))
    on = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & (F.col("block") == F.col("_block"))
    both = both.join(lengths, on).withColumn("seg_to", F.col("run") + F.col("skip"))
    seg_from = F.col("seg_to") - F.length("content")
    return both.select(
        "conv_id", "perspective", "turn_ix", "turn", "speaker", "role", "content",
        seg_from.alias("seg_from"), "seg_to",
        F.when(F.col("mine"), seg_from + F.col("head")).alias("mask_from"),
        F.when(F.col("mine"), F.col("seg_to") - 1).alias("mask_to"),
    )


def render(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks) for conversations that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn_ix", "content", "mask_from", "mask_to")))
    df = rotated.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    masks = F.filter(F.transform("p", lambda x: F.struct(x["mask_from"].alias("from"), x["mask_to"].alias("to"))), lambda m: m["from"].isNotNull())
    return df.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["content"]), "").alias("text"), masks.alias("masks"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
_NAME = _ESCAPED.format("translate(speaker, chr(13) || chr(10), '  ')")
SQL = f"""
with t as (select conv_id, turn, coalesce(trim(role), 'unknown') as speaker, coalesce(text, '') as text from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, speaker, text) - 1 as turn_ix from t),
p as (select distinct conv_id as pc, speaker as perspective from t where speaker <> 'system'),
b as (
  select *, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user name=' || {_NAME} end as role
  from o join p on conv_id is not distinct from pc
),
c as (select *, '{START}' || role || chr(10) as head from b),
d as (select *, head || {_ESCAPED.format('text')} || '<|im_end|>' || chr(10) as content from c),
e as (select *, sum(length(content)) over (partition by conv_id, perspective order by turn_ix)::bigint as seg_to from d)
select conv_id, perspective, turn_ix, turn, speaker, role, content, seg_to - length(content) as seg_from, seg_to,
  case when speaker = perspective then seg_to - length(content) + length(head) end as mask_from,
  case when speaker = perspective then seg_to - 1 end as mask_to
from e
"""
