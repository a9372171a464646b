"""Preference pairs: one shared prompt and two masked completions.

The turns of the chosen and of the rejected conversation of a pair are lined up; the prompt
is the longest common prefix of whole turns (same role, same text), rendered once. What
follows on either side is that side's completion, with the spans a trainer may learn from: the
texts of the assistant's turns and their end marks, never role headers or other speakers.

Defined cases: turns stand in the order of their number (null first), then role and text. A null text renders as
empty, a null role as ``unknown``; both compare equal to their own kind only. Equal conversations give a
prompt and two empty completions; a pair that lacks one side is not a pair and is left out. Repeated turns are turns. Empty tables give an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import let, next_in_order
from credence.session import stage

HEADER, TURN_END = "<|{}|>\n", "\n<|end|>\n"
LEARNT_ROLE = "assistant"


def conversations(turns: DataFrame, pair_col: str, name: str) -> DataFrame:
    """(pair, turns): the ordered turns of each conversation."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    one = F.struct(F.col("turn").alias("turn"), role.alias("role"), F.col("text").cast("string").alias("text"))
    return turns.groupBy(F.col(pair_col).alias("pair")).agg(F.sort_array(F.collect_list(one)).alias(name))


def _same(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & a["text"].eqNullSafe(b["text"])


def _prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(
        F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: ~_same(F.get(a, i), F.get(b, i)),
    )
    return F.coalesce(F.array_min(differs), shorter)


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(TURN_END))


def _header(turn: Column) -> Column:
    before, after = HEADER.split("{}")
    return F.concat(F.lit(before), turn["role"], F.lit(after))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """(start, end) code point spans of the rendered turns that may be learnt from."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def add(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_header(t))
        end = start + F.length(_body(t))
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == LEARNT_ROLE, F.concat(a["spans"], own)).otherwise(a["spans"])
        return F.struct(end.alias("at"), spans.alias("spans")).cast(kind)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)
    return F.aggregate(turns, empty, add, lambda a: a["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair") -> DataFrame:
    """One row a pair: ``prompt``, ``prompt_turns``, and text and mask of both completions."""
    both = conversations(chosen, pair_col, "c").join(conversations(rejected, pair_col, "r"), "pair")
    cut = both.withColumn("k", _prefix(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(F.col(side), F.col("k") + 1, F.greatest(F.size(side) - F.col("k"), F.lit(0)))
    return cut.select(
        "pair", F.col("k").alias("prompt_turns"),
        render(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        let(rest("c"), lambda t: F.struct(render(t).alias("text"), mask(t).alias("mask"))).alias("chosen"),
        let(rest("r"), lambda t: F.struct(render(t).alias("text"), mask(t).alias("mask"))).alias("rejected"),
    )


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs made of plain conversations: chosen is the conversation, rejected is the same one whose last assistant turn is
    that of the next conversation with one, in the order of ids of any kind (for the last id: of the one before), and which ends there.
    Every conversation with an assistant turn gives a pair, unless it is the only one; those without, and null ids, give none.
    Null turn numbers come first. An answer that equals the other gives equal sides up to there."""
    plain = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    said = plain.where(F.col("role") == LEARNT_ROLE)
    last = stage(said.groupBy("pair").agg(F.max(F.struct("turn", "text")).alias("last")), "last-answers")
    partner = next_in_order(last, "pair", "partner")
    other = last.select(F.col("pair").alias("partner"), F.col("last.text").alias("text"))
    answers = last.select("pair", F.col("last.turn").alias("at")).join(partner, "pair").join(other, "partner").drop("partner")
    before = F.when(F.col("turn").isNull(), F.col("at").isNotNull()).otherwise(F.col("turn") < F.col("at"))
    heads = plain.join(answers.select("pair", "at"), "pair").where(before).drop("at")
    tails = answers.select("pair", F.col("at").alias("turn"), F.lit(LEARNT_ROLE).alias("role"), "text")
    chosen = plain.join(answers.select("pair"), "pair", "left_semi")
    return chosen, heads.unionByName(tails)


def report(pairs: DataFrame) -> DataFrame:
    learnt = lambda side: F.aggregate(f"{side}.mask", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return pairs.select(
        F.col("pair").alias("conv_id"), F.col("prompt_turns").cast("long").alias("prompt_turns"),
        digest("prompt").alias("prompt_sha256"), digest("chosen.text").alias("chosen_sha256"),
        digest("rejected.text").alias("rejected_sha256"),
        learnt("chosen").cast("long").alias("chosen_learnt"), learnt("rejected").cast("long").alias("rejected_learnt"),
    )
