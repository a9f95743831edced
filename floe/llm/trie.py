"""Prefix trie of conversations by whole-sequence collapse.

1. Turns become rows (conv_id, pos, digest, chars) in order; a prefix is named by sums of
   four 32-bit pieces of each turn's (position, role, text) digest, so prefix names are
   running sums and a very long conversation is summed in cells of ``CELL`` turns.
2. Identical conversations collapse into one weighted sequence.  Its end list (the ids of
   its conversations, ascending) is made in pieces of ``PIECE`` ids by range of (sequence,
   id) and hashed piece by piece, so no list is held whole.
3. An anti-join drops the sequences that are proper prefixes of others: the rest are leaves.
4. The prefixes of the distinct sequences, weighted, are aggregated once into nodes, with
   map-side partial sums, so a first turn that a third of all share costs one row a task.

Sums over a subtree need no ancestor-descendant pairs.  A node's smallest member is its
owner; on a sequence's path its owned nodes are those from one depth on.  So for a node at
depth d, with P the code points before its last turn, summed over the sequences through it:
sum of n * chars in the subtree = sum w (total - P), and sum of chars of its distinct
nodes = sum (total - P_max(d, o)), o being the first depth the sequence owns.

Defined results: rows without conv_id take no part; a null role or text is empty; turns
that tie are ordered by their md5 digest, and repeated rows are repeated turns; a
conversation left without turns ends at the root; without conversations there are no nodes.
Only the named columns are read, other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floe.llm.common import staged
from floe.operators.ordering import running_totals

CELL = 4_096
PIECE = 50_000
SALTS = 8
KEY = ["ka", "kb"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, size, role, text's digest, chars) of every turn, null turns first."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    order = ["conv_id", "turn", "digest"]
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
                                 F.char_length(text).cast("long").alias("chars")).filter("conv_id is not null")
    # the number of a row's range is written down, so both phases of the running totals see the same one
    ranged = staged(turns.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "turns")
    return staged(running_totals(ranged, ["conv_id"], order[1:], {}, index_col="pos", size_col="size",
                                 bucket=F.col("range")).select("conv_id", "pos", "size", "digest", "chars"), "ordered")


def _cells(rows: DataFrame, length: str) -> DataFrame:
    """One copy of a conversation's row for each cell of its turns, so that joins split a long one."""
    return rows.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(length) / CELL))))


def _cell(pos: Column) -> Column:
    return F.floor(pos / CELL)


def borrow_openings(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open as the first of their id group does: (turns, conversations).

    Conversation c starts with the first h turns of c - c % ``group`` (all if fewer, none if
    absent), h being crc32 of c in decimal mod ``most``; its own turns after its first h follow.
    """
    sizes = turns.filter("pos = 0").select("conv_id", "size")
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    plan = sizes.select("conv_id", "size", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    plan = plan.join(first, "base", "left").withColumn("m", F.least("h", F.coalesce("base_size", F.lit(0))))
    plan = staged(plan.withColumn("n_turns", F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "openings")
    own = turns.withColumn("cell", _cell(F.col("pos"))).join(
        _cells(plan.select("conv_id", "h", "m", F.col("size").alias("s")), "s"), ["conv_id", "cell"]).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "chars")
    openings = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = openings.join(plan.filter("m > 0").select("base", "conv_id", "m"), "base").filter("pos < m").select(
        "conv_id", "pos", "digest", "chars")
    return own.union(lent), plan.select("conv_id", "n_turns")


def _key(depth: Column, pieces: list[Column]) -> list[Column]:
    """A 128-bit name of a prefix."""
    return [F.xxhash64(depth, *pieces).alias("ka"), F.xxhash64(F.lit(1), *pieces[::-1], depth).alias("kb")]


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n_turns, key, parent's key, chars, before) of every prefix but the root."""
    halves = [F.xxhash64("pos", "digest"), F.xxhash64("digest", "pos", F.lit(1))]
    pieces = [f(h) for h in halves for f in (lambda h: F.shiftrightunsigned(h, 32),
                                             lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    named = staged(turns.select("conv_id", "pos", "chars", *[p.alias(f"p{i}") for i, p in enumerate(pieces)]), "rebuilt")
    sums = running_totals(named, ["conv_id"], ["pos"], {**{f"s{i}": F.col(f"p{i}") for i in range(4)},
                                                        "upto": F.col("chars")}, size_col="n_turns",
                          bucket=_cell(F.col("pos")))
    depth = (F.col("pos") + 1).cast("long")
    own = _key(depth, [F.col(f"s{i}") for i in range(4)])
    parent = _key(F.col("pos").cast("long"), [F.col(f"s{i}") - F.col(f"p{i}") for i in range(4)])
    return sums.select("conv_id", depth.alias("depth"), "n_turns", *own, parent[0].alias("pa"), parent[1].alias("pb"),
                       "chars", (F.col("upto") - F.col("chars")).alias("before"))


def _pieces(batches):
    """Sorted (key, id) rows to pieces of an end list."""
    held: list[int] = []
    key = None

    def piece():
        return pd.DataFrame({"ka": [key[0]], "kb": [key[1]], "low": [held[0]], "n": [len(held)],
                             "ids": [",".join(map(str, held))]})

    for part in batches:
        for ka, kb, conv in zip(part["ka"].tolist(), part["kb"].tolist(), part["conv_id"].tolist()):
            if held and ((ka, kb) != key or len(held) == PIECE):
                yield piece()
                held = []
            key = (ka, kb)
            held.append(conv)
    if held:
        yield piece()


def _end_hashes(batches):
    """Sorted pieces to one hash a sequence; only the hash's state is held."""
    key, state = None, None
    for part in batches:
        out = []
        for ka, kb, ids in zip(part["ka"].tolist(), part["kb"].tolist(), part["ids"]):
            if (ka, kb) == key:
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (ka, kb), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["ka", "kb", "ends_sha256"]).astype({"ka": "int64", "kb": "int64"})
    if key:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["ka", "kb", "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, pos from 0 without gaps, digest, chars).

    ``conversations`` (conv_id, n_turns) names every conversation, turnless ones too.  Returns
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    zero = F.lit(0).cast("long")
    root = _key(zero, [zero] * 4)
    prefixes = staged(_prefixes(turns), "prefixes")
    ends = prefixes.filter("depth = n_turns").select(*KEY, "conv_id").union(
        conversations.filter("n_turns = 0").select(*root, "conv_id"))
    # whole sequences, weighted, with their end lists
    lists = staged(ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInPandas(
        _pieces, "ka long, kb long, low long, n long, ids string"), "end_lists")
    hashes = lists.repartition(*KEY).sortWithinPartitions(*KEY, "low").mapInPandas(
        _end_hashes, "ka long, kb long, ends_sha256 string")
    sequences = lists.groupBy(*KEY).agg(F.sum("n").alias("weight"), F.min("low").alias("rep"))
    totals = prefixes.filter("depth = n_turns").select(
        F.col("conv_id").alias("rep"), "n_turns", (F.col("before") + F.col("chars")).alias("total"))
    sequences = staged(sequences.join(totals, "rep", "left").fillna(0, ["n_turns", "total"]), "sequences")
    # the paths of the distinct sequences; the root is a node of each
    paths = prefixes.select(F.col("conv_id").alias("rep"), "depth", *KEY, "pa", "pb", "chars", "before").withColumn(
        "cell", _cell(F.col("depth"))).join(_cells(sequences.select("rep", "n_turns"), "n_turns"), ["rep", "cell"])
    paths = paths.unionByName(sequences.select(
        "rep", zero.alias("cell"), zero.alias("depth"), *root, zero.alias("pa"), zero.alias("pb"), zero.alias("chars"),
        zero.alias("before"), "n_turns"))
    paths = staged(paths, "paths")
    proper = paths.filter("depth < n_turns").select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    owners = paths.groupBy(*KEY).agg(F.min("rep").alias("rep"), F.min(F.struct("depth", "before")).alias("at"))
    owned = owners.groupBy("rep").agg(F.min("at").alias("o")).select(
        "rep", F.col("o.depth").alias("o_depth"), F.col("o.before").alias("o_before"))
    facts = sequences.select("rep", "n_turns", "weight", "total").join(leaves, "rep", "left").join(owned, "rep", "left")
    facts = staged(facts.fillna(0, ["leaf"]), "facts")
    through = paths.drop("n_turns").join(_cells(facts, "n_turns"), ["rep", "cell"])
    distinct = F.when(F.col("depth") >= F.coalesce("o_depth", F.col("n_turns") + 1), F.col("before")).otherwise(
        F.coalesce("o_before", "total"))
    nodes = staged(through.groupBy(*KEY).agg(
        F.min(F.struct("rep", "o_depth")).alias("owner"), F.min("depth").alias("depth"), F.min("pa").alias("pa"),
        F.min("pb").alias("pb"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - distinct)).alias("saved_tokens")
    ).select(*KEY, F.col("owner.rep").alias("conv_id"), F.col("owner.o_depth").alias("o_depth"), "depth", "pa", "pb",
             "n_convs", "n_leaves", "saved_tokens"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").join(hashes, KEY, "left")
    # only the first node that a sequence owns has a parent of another owner
    top = (F.col("depth") > 0) & (F.col("depth") == F.col("o_depth"))
    tops = nodes.filter(top)
    above = tops.select(F.col("pa").alias("ka"), F.col("pb").alias("kb")).distinct().join(
        nodes.select(*KEY, F.col("conv_id").alias("parent")), KEY)
    above = above.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("parent").alias("parent_conv_id"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    tops = tops.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(
        above, ["pa", "pb", "salt"])
    rest = nodes.filter(~top).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return rest.unionByName(tops.drop("salt")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def node_turns(nodes: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turn, for conversations that borrow nothing.

    ``turns`` is ``ordered_turns(conversations)``; the root has a null role and text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), digest.alias("digest"),
                                role.alias("role"), text.alias("text")).dropDuplicates(["conv_id", "digest"])
    at = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest")
    return nodes.join(at, ["conv_id", "depth"], "left").join(said, ["conv_id", "digest"], "left").drop("digest")
