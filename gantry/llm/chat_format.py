"""Chat formatting by perspective rotation: every participant in turn is the assistant.

For each participant of a conversation the dialogue is rendered with that speaker's messages as the
assistant's and all others as those of named users; system messages stay what they are. What is
trained on is the assistant's text and its end mark, not the headers.

The result has a row per message and perspective: its segment of the rendered dialogue, where the
segment lies in it, and the trained part of it. Segments in the order of `seq` make the dialogue,
see dialogues(). Places are running sums over pieces of `chunk_turns` turns, then over the pieces, so
that no task holds a whole conversation.

Everything is a DataFrame expression.

Defined results: messages are ordered by turn (nulls last), then role, then the MD5 of the text;
repeated rows are as many messages; a null role is a participant named `unknown`; a null text is
empty; messages without conversation id are one conversation; a conversation of system messages only
has no perspective; an empty table gives an empty result; other columns play no part. Marks that
appear in a text or name are broken by a blank. Places count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gantry.llm.common import read


@dataclass(frozen=True)
class ChatFormat:
    fixed_roles: tuple[str, ...] = ("system",)
    assistant: str = "<|assistant|>\n"
    user: str = "<|user %s|>\n"
    fixed: str = "<|%s|>\n"
    end: str = "<|end|>\n"
    unknown: str = "unknown"
    chunk_turns: int = 256


def _plain(text: Column) -> Column:
    """The text without anything that reads as a mark."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _header(pattern: str, name: Column) -> Column:
    before, after = pattern.split("%s")
    return F.concat(F.lit(before), name, F.lit(after))


def rotated(messages: DataFrame, form: ChatFormat = ChatFormat(), conv: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, speaker, seq, turn, role, segment, start, stop, train_start, train_stop)."""
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(form.unknown)).alias("role"),
        F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.withColumn("chunk", F.coalesce(
        F.floor(F.col("turn") / form.chunk_turns), F.lit((1 << 62) - 1)).cast("long"))
    rows = rows.withColumn("h", F.md5("t")).withColumn("t", _plain(F.col("t")))
    parties = rows.filter(~F.col("role").isin(*form.fixed_roles)).select(
        F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    both = rows.join(parties, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    mine, name = F.col("role") == F.col("speaker"), _plain(F.col("role"))
    header = F.when(mine, F.lit(form.assistant)).when(
        F.col("role").isin(*form.fixed_roles), _header(form.fixed, name)).otherwise(_header(form.user, name))
    segment = F.concat(header, "t", F.lit(form.end))
    both = both.select("conv_id", "speaker", "chunk", "turn", "role", "h", segment.alias("segment"),
                       F.length(header).alias("n_header"), F.length(segment).cast("long").alias("n"), mine.alias("mine"))
    both = both.repartition("conv_id", "speaker", "chunk")

    piece = W.partitionBy("conv_id", "speaker", "chunk")
    order = piece.orderBy(F.col("turn").asc_nulls_last(), "role", "h")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    placed = both.withColumns({"seq": F.row_number().over(order) - 1, "start": F.coalesce(F.sum("n").over(before), F.lit(0))})
    totals = both.groupBy("conv_id", "speaker", "chunk").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    earlier = W.partitionBy("conv_id", "speaker").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("chunk").alias("k"),
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    placed = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s"))
                         & (F.col("chunk") == F.col("k")))
    start = F.col("start") + F.col("n0")
    return placed.select(
        "conv_id", "speaker", (F.col("seq") + F.col("m0")).cast("long").alias("seq"), "turn", "role", "segment",
        start.alias("start"), (start + F.col("n")).alias("stop"),
        F.when(F.col("mine"), start + F.col("n_header")).alias("train_start"),
        F.when(F.col("mine"), start + F.col("n")).alias("train_stop"))


def dialogues(segments: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, speaker, part, text, trained): the dialogues, cut between messages into parts that begin
    within `max_chars` characters; trained holds the [start, stop) spans within the part."""
    part = F.floor(F.col("start") / max_chars)
    gathered = segments.groupBy("conv_id", "speaker", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(
        "seq", "segment", "start", "train_start", "train_stop"))).alias("s"))
    origin = F.col("s")[0].start
    spans = F.transform(F.filter("s", lambda x: x.train_start.isNotNull()), lambda x: F.struct(
        (x.train_start - origin).alias("start"), (x.train_stop - origin).alias("stop")))
    return gathered.select("conv_id", "speaker", "part", F.array_join("s.segment", "").alias("text"), spans.alias("trained"))


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(read(spark, sf_dir, "conversations"))


OP1_SQL = """
with messages as (
  select conv_id, turn, coalesce(role, 'unknown') as role, md5(coalesce(text, '')) as h,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') as t
  from conversations),
parties as (select distinct conv_id as c, role as speaker from messages where role <> 'system'),
rendered as (
  select m.*, p.speaker, m.role = p.speaker as mine,
         case when m.role = p.speaker then '<|assistant|>' when m.role = 'system' then '<|system|>'
              else '<|user ' || replace(replace(m.role, '<|', '< |'), '|>', '| >') || '|>' end || chr(10) as header
  from messages m join parties p on m.conv_id is not distinct from p.c),
sized as (
  select *, header || t || '<|end|>' || chr(10) as segment from rendered),
placed as (
  select *, row_number() over w - 1 as seq,
         coalesce(sum(length(segment)) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized window w as (partition by conv_id, speaker order by turn nulls last, role, h))
select conv_id, speaker, seq, turn, role, segment, start, start + length(segment) as stop,
       case when mine then start + length(header) end as train_start,
       case when mine then start + length(segment) end as train_stop
from placed
"""
