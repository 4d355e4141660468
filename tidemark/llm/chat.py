"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that speaker as `assistant`, all
others as named users and system turns as `system`; the mask covers what that speaker says, with its end mark.
A rendering comes in parts of turns from a block of `PART_TURNS` turn numbers (a usual conversation is one part),
so that no conversation, however long, is gathered into one task; `start_char` places a part in the rendering.

Defined results: a null conv_id is a conversation of its own; null roles are the speaker `unknown`, null texts are
empty; a null turn sorts before all others; turns with equal numbers are ordered by role, then text; repeated rows
are repeated turns. A conversation that has system turns alone has no participant and gives no row. `<|` inside
texts and names is rendered `<\\|`, so that marks can't be forged. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import table

PART_TURNS = 64
END = "<|end|>\n"
#: Parts that one window sums; sums of these blocks are summed again.
BLOCK_PARTS = 4096


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def _head(role: Column, own: Column, system: str) -> Column:
    return F.when(role == system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _starts(turns: DataFrame, system: str) -> DataFrame:
    """(k, part, perspective, start_char) from lengths alone: a part is as long for everyone, but for the heads of the speaker's own turns."""
    role, none, every = F.col("role"), F.lit(False), F.lit(True)
    size = F.length(_head(role, none, system)) + F.length("text") + F.length(F.lit(END))
    spoken = turns.groupBy("k", "part", "role").agg(F.sum(size.cast("long")).alias("chars"), F.count(F.lit(1)).alias("n"))
    people = spoken.filter(role != system).select("k", role.alias("perspective")).distinct()
    whole = spoken.groupBy("k", "part").agg(F.sum("chars").alias("chars")).join(people, "k").select("k", "part", "perspective", "chars")
    less = spoken.filter(role != system).select("k", "part", role.alias("perspective"), (F.col("n") * (F.length(_head(role, every, system)) - F.length(_head(role, none, system)))).alias("chars"))
    each = whole.unionByName(less).groupBy("k", "perspective", "part").agg(F.sum("chars").alias("chars")).withColumn("block", F.floor(F.col("part") / BLOCK_PARTS))
    # two-level prefix sums: a window holds the parts of one block, another the sums of the blocks
    key = ["k", "perspective"]
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = each.groupBy(*key, "block").agg(F.sum("chars").alias("block_chars")).select(*key, "block", before("block_chars", W.partitionBy(*key).orderBy("block")).alias("block_start"))
    within = each.select(*key, "block", "part", before("chars", W.partitionBy(*key, "block").orderBy("part")).alias("within"))
    return within.join(sums, [*key, "block"]).select("k", "part", "perspective", (F.col("block_start") + F.col("within")).alias("start_char"))


def rotate(df: DataFrame, system: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, part, n_turns, start_char, text, mask); mask has [from, to) within the part's text.

    Texts are shuffled once, by part, and rendered last; where parts start is told before from rows without text."""
    turns = df.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("k"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        _safe(F.coalesce("role", F.lit("unknown"))).alias("role"),
        _safe(F.coalesce("text", F.lit(""))).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(2**62))).cast("long"))
    parts = turns.groupBy("k", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    both = parts.join(_starts(turns, system), ["k", "part"])

    # one struct a turn: what precedes the speech, the speech with its end mark, whether it is trained on
    own = lambda t: t["role"] == F.col("perspective")
    seg = F.transform("said", lambda t: F.struct(_head(t["role"], own(t), system).alias("h"), F.concat(t["text"], F.lit(END)).alias("b"), own(t).alias("own")))
    out = both.withColumn("seg", seg).drop("said")
    out = out.withColumn("text", F.array_join(F.transform("seg", lambda s: F.concat(s["h"], s["b"])), ""))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("mask"))

    def step(acc: Column, s: Column) -> Column:
        speech = acc["at"] + F.length(s["h"])
        end = speech + F.length(s["b"])
        mask = F.when(s["own"], F.concat(acc["mask"], F.array(F.struct(speech.alias("from"), end.alias("to"))))).otherwise(acc["mask"])
        return F.struct(end.alias("at"), mask.alias("mask"))

    mask = F.aggregate("seg", empty, step, lambda acc: acc["mask"])
    return out.select("conv_id", "perspective", "part", F.size("seg").cast("long").alias("n_turns"), "start_char", "text", mask.alias("mask"))


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).select("conv_id", "perspective", "part", "n_turns", "start_char", "text", spans.alias("mask"))


OP1_SQL = """
with t as (
  select conv_id, cast(turn as bigint) as turn, replace(coalesce(role, 'unknown'), '<|', '<\\|') as role,
         replace(coalesce(text, ''), '<|', '<\\|') as text from conversations),
n as (select *, coalesce(cast(floor(turn / 64.0) as bigint), -4611686018427387904) as part,
             row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t),
p as (select distinct conv_id, role as perspective from t where role <> 'system'),
s as (
  select n.conv_id, p.perspective, n.part, n.pos, n.role = p.perspective as own,
         case when n.role = 'system' then '<|system|>' when n.role = p.perspective then '<|assistant|>'
              else '<|user name=' || n.role || '|>' end || chr(10) as head,
         n.text || '<|end|>' || chr(10) as body
  from n join p on n.conv_id is not distinct from p.conv_id),
o as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, perspective order by pos) - length(head) - length(body) as upto,
         min(pos) over (partition by conv_id, perspective, part) as first_pos from s),
q as (select *, min(upto) over (partition by conv_id, perspective, part) as start_char from o)
select conv_id, perspective, part, count(*) as n_turns, cast(min(start_char) as bigint) as start_char,
       string_agg(head || body, '' order by pos) as text,
       coalesce(string_agg(case when own then cast(cast(upto - start_char + length(head) as bigint) as varchar) || '-' ||
                cast(cast(upto - start_char + length(head) + length(body) as bigint) as varchar) end, ',' order by pos), '') as mask
from q group by conv_id, perspective, part
"""
