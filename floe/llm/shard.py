"""Minimax contiguous partition of a corpus into shards (native).

Groups of equal texts are atomic and stand in the order of their smallest
doc_id.  Wanted is the smallest capacity with which greedy filling, group after
group, needs at most ``shards`` shards.  Running totals over the ordered rows are
written once, as a table sorted by their total.  A greedy step from position s
under capacity C ends at the largest group end <= s + C, so checking a capacity
needs ``shards`` look-ups in that table.  The search interval (at most one
largest group wide) is cut into ``PROBES`` + 1 parts at once, and all probes
advance together.  The driver knows the table by at most ``BLOCKS`` blocks of its
range; blocks in which a probe ends are cut finer by one aggregate over the files
whose statistics overlap them.  Finally every row gets its shard by
comparing its running total with the cuts, without a join.

Defined results: a null text is an empty one (size 1, crc32 0); repeated rows
are separate rows of one group; a null doc_id sorts first; fewer groups than
shards leave shards empty; without documents the result is empty.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.llm.common import staged
from floe.operators.ordering import running_totals

PROBES = 15
BLOCKS = 4_096
FINER = 64


class Ends:
    """Group ends, known to the driver as blocks (first end, last end, groups) that are cut finer on demand.

    One aggregate makes at most ``BLOCKS`` blocks; each finer cut of a block
    makes at most ``FINER``, and only blocks that a probe ends in are cut.
    """

    def __init__(self, ends: DataFrame, total: int):
        self.ends = ends
        self.blocks = self._cut([(0, total)], BLOCKS)

    def _cut(self, ranges: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int]]:
        """Blocks of the ends in the ranges (low, high], each range cut into ``parts``."""
        at, inside, part = F.col("finish"), F.lit(False), F.lit(None).cast("long")
        for i, (low, high) in enumerate(ranges):
            here = (at > low) & (at <= high)
            number = F.floor((at - low - 1).cast("double") * parts / (high - low)).cast("long")
            inside, part = inside | here, F.when(here, i * parts + number).otherwise(part)
        rows = self.ends.filter(inside).groupBy(part.alias("b")).agg(
            F.min("finish").alias("f"), F.max("finish").alias("l"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["f"], r["l"], r["n"]) for r in rows)

    def last_up_to(self, aims: list[int]) -> list[int]:
        """For each aim the largest end <= aim (0 if there is none)."""
        while True:
            firsts, out, open_ = [x[0] for x in self.blocks], [], set()
            for aim in aims:
                i = bisect.bisect_right(firsts, aim) - 1
                first, last, n = self.blocks[i] if i >= 0 else (0, 0, 1)
                if aim < last and n > 2:
                    open_.add(self.blocks[i])
                out.append(last if aim >= last else first)
            if not open_:
                return out
            finer = self._cut([(first - 1, last) for first, last, _ in sorted(open_)], FINER)
            self.blocks = sorted([x for x in self.blocks if x not in open_] + finer)


def smallest_capacity(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, group ends at which a shard closes) for ``ends`` (finish, weight)."""
    largest, total = ends.agg(F.max("weight"), F.max("finish")).first()
    if total is None:
        return 0, []
    known = Ends(ends, total)
    lo, hi = max(largest, -(-total // shards)), -(-total // shards) + largest     # greedy always fits in hi
    while lo < hi:
        probes = sorted({lo + (hi - lo) * i // (PROBES + 1) for i in range(PROBES + 1)})
        fits = [c for c, cuts in zip(probes, _fill(known, probes, shards, total)) if cuts]
        if fits:
            hi = fits[0]
        below = [c for c in probes if c < hi]
        lo = below[-1] + 1 if below else hi
    return hi, _fill(known, [hi], shards, total)[0]


def _fill(known: Ends, capacities: list[int], shards: int, total: int) -> list[list[int] | None]:
    """The cuts of greedy filling under each capacity; None where ``shards`` don't suffice."""
    cuts: list[list[int]] = [[0] for _ in capacities]
    for _ in range(shards):
        moving = [i for i, c in enumerate(cuts) if c[-1] < total]
        for i, cut in zip(moving, known.last_up_to([cuts[i][-1] + capacities[i] for i in moving])):
            cuts[i].append(cut)
    return [c[1:] if c[-1] == total else None for c in cuts]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = staged(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("same")), "sized")
    # written first: between two plain exchanges adaptive execution can split a hot group's rows
    lead = staged(rows.groupBy("same").agg(F.min("doc_id").alias("first_id")), "lead")
    grouped = rows.join(lead.withColumnRenamed("same", "_same"), F.col("same") == F.col("_same")).drop("_same")
    grouped = staged(grouped, "grouped")
    # (first id, text) names a group; rows of a group that still tie are alike.  The number of a
    # row's range is written down, so both phases of the running totals see the same one.
    order = ["first_id", "same", "doc_id"]
    ranged = staged(grouped.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    ordered = staged(running_totals(ranged, [], order, {"finish": F.col("size")}, index_col="place",
                                    bucket=F.col("range")), "ordered")
    ends = staged(ordered.groupBy("first_id", "same").agg(
        F.max("finish").alias("finish"), F.sum("size").alias("weight")).select("finish", "weight")
        .repartitionByRange("finish").sortWithinPartitions("finish"), "ends")
    _, cuts = smallest_capacity(ends, shards)
    # shard = how many cuts lie before the row; the last cut closes the last shard
    edges = cuts[:-1]
    shard = F.lit(0)
    for cut in edges:
        shard = shard + (F.col("finish") > cut).cast("int")
    begins = [0] * shards
    if edges:
        counts = ordered.agg(*[F.count(F.when(F.col("finish") <= cut, 1)) for cut in edges]).first()
        begins[1:1 + len(edges)] = list(counts)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in begins]), F.col("shard") + 1)
    return ordered.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - start).alias("slot"))
