"""Embedding near-dedup with iterative quantisation and multi-index Hamming tables.

1. Equal vectors are one class, weighted by its rows, so thousands of copies cost one class.
2. Iterative quantisation, fitted in numpy on a bounded sample (``FIT_ROWS`` unit vectors,
   by hash): principal axes, then a rotation that alternately takes the sign codes and the
   orthogonal matrix nearest to them.  Bits are cut at the sample's median, so they are
   balanced.  Further rotations from other random starts give longer codes.
3. The code is cut into tables of ``width`` bits, log2 of the number of classes at least, so
   an average bucket stays small at any size.  The number of tables is measured, not guessed:
   tables are added until, of made pairs at exactly the threshold, ``RECALL`` share a table.
4. A first pass sees only ids and a 128-bit part of the code: classes meet in the buckets of
   each table and those with a partner in Hamming distance stay.  Their vectors are fetched,
   and a second pass reranks: cosines in double precision of all pairs that stayed.  A pair
   counts in the first table that holds it, which both codes tell, so pairs are neither
   listed nor made distinct: a task emits a count for each class and a spanning forest.
5. Buckets of more than ``BLOCK`` classes are dealt into blocks, block against block, so any
   group has at most 2 * ``BLOCK`` rows and no bucket is capped.
6. Components by union-find in tasks and star contraction across them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths are not compared; repeated rows stay rows and
rows that share a vec_id go by their own vectors; rows without vec_id take part, get the
component's smallest vec_id (null if it has none) and are not kept where there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.llm.common import finished, released, staged
from floe.llm.components import components

FIT_ROWS = 8_192
FIT_BYTES = 64 << 20
ROUNDS = 30
RECALL = 0.995
MAX_TABLES = 96
SHORT = 128               # code bits that the first pass sees
BLOCK = 256


def unit(vectors) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first, so that squares stay finite."""
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Codes:
    mean: np.ndarray
    axes: np.ndarray          # dimensions x bits
    cuts: np.ndarray
    width: int
    tables: int = 0
    radius: int = 0

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes > self.cuts

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One number a table for each row."""
        bits = self.bits(x)[:, :self.tables * self.width].reshape(len(x), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))

    def short(self, x: np.ndarray) -> np.ndarray:
        """The first ``SHORT`` bits as two 64-bit words."""
        bits = self.bits(x)[:, :SHORT]
        padded = np.zeros((len(x), SHORT), bool)
        padded[:, :bits.shape[1]] = bits
        return np.packbits(padded, axis=1).view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between 64-bit words (bitwise_count would take a negative number's absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(int)


def rotation(data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix that brings the rows of ``data`` close to the corners of a cube."""
    turn = np.linalg.qr(rng.normal(size=(data.shape[1], data.shape[1])))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(data @ turn > 0, 1.0, -1.0).T @ data)
        turn = (left @ right).T
    return turn


def fit_codes(sample: np.ndarray, classes: int, threshold: float, seed: int = 13) -> Codes:
    """Codes for ``classes`` unit vectors, fitted on the unit vectors ``sample``."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    width = max(12, int(np.ceil(np.log2(max(classes, 2)))))
    mean = sample.mean(0)
    _, axes = np.linalg.eigh((sample - mean).T @ (sample - mean))
    axes = axes[:, ::-1]
    # pairs at exactly the threshold, each from a sampled vector and a random direction
    near = sample[rng.integers(0, len(sample), 2_000)]
    away = rng.normal(size=near.shape)
    away -= (away * near).sum(1, keepdims=True) * near
    norm = np.sqrt((away * away).sum(1, keepdims=True))
    made = threshold * near + np.sqrt(1 - threshold ** 2) * away / np.where(norm > 0, norm, 1)
    codes = Codes(mean, np.zeros((dims, 0)), np.zeros(0), width)
    found = np.zeros(len(near), bool)
    while codes.tables < MAX_TABLES and found.mean() < RECALL:
        while codes.axes.shape[1] < (codes.tables + 1) * width:
            more = axes @ rotation((sample - mean) @ axes, rng)
            codes.axes = np.hstack([codes.axes, more])
            codes.cuts = np.append(codes.cuts, np.median((sample - mean) @ more, axis=0))
        codes.tables += 1
        found |= codes.keys(near)[:, -1] == codes.keys(made)[:, -1]
    apart = differing(codes.short(near), codes.short(made)).sum(1)
    codes.radius = int(np.ceil(apart.mean() + 6 * apart.std()))
    return codes


def _groups(batches, key: str):
    """Batches cut so that no group of equal ``key`` is parted; rows come sorted by it."""
    held = None
    for part in released(batches):
        part = part if held is None else pd.concat([held, part], ignore_index=True)
        values = part[key].to_numpy()
        start = int(np.searchsorted(values, values[-1])) if len(values) else 0
        held = part.iloc[start:].reset_index(drop=True)
        if start:
            yield part.iloc[:start].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _meetings(part: pd.DataFrame):
    """Index arrays (i, j) of the pairs in each group, those at one distance in sort order at a time."""
    group, block = part["group"].to_numpy(), part["block"].to_numpy()
    crossed = part["crossed"].to_numpy()
    i = np.arange(len(part))
    step = 1
    while True:
        i = i[i + step < len(part)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            return
        j = i + step
        met = ~crossed[i] | (block[i] != block[j])
        yield i[met], j[met]
        step += 1


def _promising(radius: int):
    """Rows with a partner in Hamming distance."""
    def run(batches):
        for part in _groups(batches, "group"):
            a, b = part["a"].to_numpy(), part["b"].to_numpy()
            keep = np.zeros(len(part), bool)
            for i, j in _meetings(part):
                close = differing(a[i], a[j]) + differing(b[i], b[j]) <= radius
                keep[i[close]] = keep[j[close]] = True
            yield part.loc[keep, ["group", "table", "block", "crossed", "cid"]]
    return run


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: (other nodes, smallest node)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    other = low != np.arange(len(nodes))
    return nodes[other], nodes[low[other]]


def _rerank(codes: Codes, threshold: float):
    """Counts (cid, links) and forest edges (u, v) of the true pairs of each group."""
    def run(batches):
        for part in _groups(batches, "group"):
            x = unit(part["v"])
            keys, table = codes.keys(x), part["table"].to_numpy()
            cid, weight = part["cid"].to_numpy(), part["weight"].to_numpy()
            links = np.zeros(len(part), np.int64)
            us, vs = [], []
            for i, j in _meetings(part):
                first = (keys[i] == keys[j]).argmax(1) == table[i]
                i, j = i[first], j[first]
                good = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[good], j[good]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                us.append(cid[i])
                vs.append(cid[j])
            some = links > 0
            out = pd.DataFrame({"cid": cid[some], "links": links[some]}).groupby("cid", as_index=False).sum()
            yield out.assign(u=pd.array([None] * len(out), "Int64"), v=pd.array([None] * len(out), "Int64"))
            if us and sum(map(len, us)):
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                yield pd.DataFrame({"cid": pd.array([None] * len(u), "Int64"), "links": pd.array([None] * len(u), "Int64"),
                                    "u": u, "v": v})
    return run


def _links(classes: DataFrame, number: int, threshold: float) -> tuple[DataFrame, Codes]:
    """(cid, links, u, v) for classes (cid, v, weight) of one vector length."""
    spark = classes.sparkSession
    size = classes.select(F.size("v")).first()[0]
    rows = max(min(FIT_ROWS, FIT_BYTES // (8 * size)), 1)
    share = min(1.0, rows / number)
    chosen = F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = classes.filter(chosen).select("v").toPandas()["v"]
    if not len(sample):
        sample = classes.select("v").limit(1).toPandas()["v"]
    codes = fit_codes(unit(sample), number, threshold)
    shared = spark.sparkContext.broadcast(codes)

    def code(batches):
        codes = shared.value
        for part in released(batches):
            if len(part):
                x = unit(part["v"])
                short = codes.short(x)
                yield pd.DataFrame({"cid": part["cid"], "a": short[:, 0], "b": short[:, 1], "keys": list(codes.keys(x))})

    coded = classes.select("cid", "v").mapInPandas(code, "cid long, a long, b long, keys array<long>")
    met = staged(coded.select("cid", "a", "b", F.posexplode("keys").alias("table", "value")), "codes")
    sizes = met.groupBy("table", "value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = met.join(staged(sizes, "buckets"), ["table", "value"])
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    met = met.withColumn("block", F.pmod(F.xxhash64("cid", "table"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select(F.xxhash64("table", "value", low, high).alias("group"), F.col("table").cast("int").alias("table"),
                     "block", (low != high).alias("crossed"), "cid", "a", "b")
    kept = staged(met.repartition("group").sortWithinPartitions("group").mapInPandas(
        _promising(codes.radius), "group long, table int, block int, crossed boolean, cid long"), "promising")
    full = kept.join(classes, "cid").repartition("group").sortWithinPartitions("group")
    found = full.mapInPandas(_rerank(codes, threshold), "cid long, links long, u long, v long")
    return staged(found, "found"), codes


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    return finished(vectors.sparkSession, "near_vectors", lambda: _near(vectors, id_col, vector_col, threshold))


def _near(vectors: DataFrame, id_col: str, vector_col: str, threshold: float) -> DataFrame:
    value = F.col(vector_col).cast("array<double>")
    usable = (F.col(vector_col).isNotNull() & (F.size(value) > 0) & F.exists(value, lambda x: x != 0)
              & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = staged(vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, value).alias("v")), "vectors")
    grouped = staged(rows.filter("v is not null").groupBy("v").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight")), "grouped")
    classes = staged(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = vectors.sparkSession.createDataFrame([], "cid long, links long, u long, v long")
    for dim, number in sorted(tuple(r) for r in classes.groupBy(F.size("v")).count().collect()):   # a row a length
        if number > 1:
            own = classes.filter(F.size("v") == dim).select("cid", "v", "weight")
            found = found.union(_links(own, number, threshold)[0])
    linked = found.filter("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.filter("u is not null").select("u", "v"))
    joined = classes.drop("v").join(comp, F.col("cid") == F.col("node"), "left").join(linked, "cid", "left")
    joined = staged(joined.select("cid", "low", "weight", F.coalesce("root", "cid").alias("root"),
                                  F.coalesce("links", F.lit(0)).alias("links")), "joined")
    names = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(names, "root").select("cid", "component_id",
                                              (F.col("links") + F.col("weight") - 1).alias("n_links"))
    member = rows.join(classes.select("v", "cid"), "v", "left").drop("v").join(named, "cid", "left")
    comp_id = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return member.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         comp_id.alias("component_id"),
                         F.coalesce(F.col("vec_id") == comp_id, comp_id.isNull()).alias("kept"))
