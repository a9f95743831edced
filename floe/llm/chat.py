"""Preference formatting (native).

Input: the turns of pairs, rows (pair_id, side, turn, role, text), side being
'chosen' or 'rejected'.  The longest common prefix of turns (equal role and text)
is rendered once as the prompt; what follows is rendered as the two completions,
each with the character spans that carry loss: texts and end marks of the
assistant's turns.  Everything is one grouping by pair and side and array
functions; a pair is one output row.

Defined results: a null role is rendered as 'unknown' and a null text as empty,
and both are equal to their like only; turns stand in the order of turn, then
role and text, and fully repeated rows count once; a pair with one side only has
the empty other side; a null pair_id is left out; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LOSS_ROLE = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(MIDDLE),
                    F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def loss_spans(turns: Column) -> Column:
    """'start-end' of each span that carries loss, as an array of text."""
    head = lambda t: F.lit(len(OPEN) + len(MIDDLE)) + F.length(F.coalesce(t["role"], F.lit("unknown")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin, end = acc["at"] + head(t), acc["at"] + F.length(_rendered(t))
        span = F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == LOSS_ROLE, F.concat(acc["spans"], span)).otherwise(
            acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prefix, prompt, chosen, rejected, chosen_spans, rejected_spans)."""
    one = F.struct("turn", "role", "text")
    sides = turns.filter("pair_id is not null and side in ('chosen', 'rejected')").groupBy("pair_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("side") == s, one))).alias(s) for s in ("chosen", "rejected")])
    same = F.zip_with("chosen", "rejected", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(
        b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, False)
    cut = sides.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int"))

    def tail(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_prefix") + 1, F.greatest(F.size(side) - F.col("n_prefix"), F.lit(0)))

    cut = cut.select("pair_id", "n_prefix", F.slice("chosen", F.lit(1), F.col("n_prefix")).alias("head"),
                     tail("chosen").alias("chosen"), tail("rejected").alias("rejected"))
    return cut.select("pair_id", "n_prefix", render(F.col("head")).alias("prompt"),
                      render(F.col("chosen")).alias("chosen"), render(F.col("rejected")).alias("rejected"),
                      loss_spans(F.col("chosen")).alias("chosen_spans"),
                      loss_spans(F.col("rejected")).alias("rejected_spans"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: rows (pair_id, side, turn, role, text).

    Conversation c is the chosen side of pair c.  Its rejected side has the same
    turns up to its last one, which is replaced by the last turn of the
    conversation whose id differs from c in the lowest bit; without such a
    neighbour the rejected side just ends there.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").distinct()
    last = rows.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("l"))
    ended = rows.join(last, "conv_id").withColumn("final", F.struct("turn", "role", "text").eqNullSafe(F.col("l")))
    chosen = ended.select("conv_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    shared = ended.filter("not final").select("conv_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    place = last.select("conv_id", F.col("l.turn").alias("turn"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"),
                        F.col("l.role").alias("role"), F.col("l.text").alias("text"))
    swapped = place.join(other, "conv_id").select("conv_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    return chosen.union(shared).union(swapped).withColumnRenamed("conv_id", "pair_id")
