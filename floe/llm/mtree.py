"""Exact top-k by inner product with M-trees and best-first search.

Vectors are integer points.  They are dealt into trees of bounded size; a tree is
bulk-loaded into pages: a node has a routing point, a covering radius and its
distance to the parent's routing point, a leaf its points and their distances to
its routing point.  For a query q, any point x under routing point c with radius r
has  q.x <= q.c + |q| r,  and  q.c <= q.p + |q| d(p, c)  for the parent p.  So a
child is dismissed by the stored d(p, c), and a leaf's point by its stored
distance, before any product with it is computed.  Nodes wait in a heap by their
bound; the search ends when the best bound is below the k-th score.  Bounds that
equal the k-th score are followed, as a tie may have a smaller id.

Every query starts with the k-th best score among a bounded pilot of points
(``PILOT``), a lower bound of its final k-th score.

Queries are met with trees in blocks: pairs (tree, query block) have bounded size
on both sides and are spread over the cluster.  A block goes through a tree's pages
together (``search_block``), so its products are matrix products; of each pair only
k rows a query leave.  Only the pilot is broadcast.

Defined results: vectors that are null, empty or hold null or non-finite
components (also after scaling) take no part; of rows that share an id the smallest vector counts;
a null id takes no part; points of another length than the query's are no
candidates; fewer than k candidates are all returned; a score beyond 64 bits fails the query.
Floors are rounded down and bounds up, so scores beyond 2^53 lose nothing.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floe.llm.common import staged

TREE_POINTS = 8_192
QUERY_BLOCK = 4_096
LEAF = 64
FAN_OUT = 16
PILOT = 1_024
HELD = 1 << 20         # candidates of a block kept before they are cut to k a query


def integer_points(vectors: pd.Series, scale: float) -> np.ndarray:
    """floor(scale * x) as exact numbers: float64 where products stay below 2^53, else Python integers."""
    rows = np.floor(scale * np.array([np.asarray(v, float) for v in vectors]))
    if not rows.size or np.abs(rows).max() ** 2 * rows.shape[1] < 2 ** 53:
        return rows
    return np.array([[int(x) for x in r] for r in rows], object)


def above(x: float) -> float:
    """The float after ``x``: a bound rounded up."""
    return math.nextafter(float(x), math.inf)


def at_most(x: int) -> float:
    """The largest float that isn't above the whole number ``x``."""
    near = float(x)
    return near if near <= x else math.nextafter(near, -math.inf)


def checked(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(abs(s) >= 1 << 63 for s in scores.flat):
        raise ValueError("a score is beyond 64 bits; lower the scale")
    return scores


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    delta = points.astype(float) - centre.astype(float)
    return np.sqrt((delta * delta).sum(1))


def build(points: np.ndarray) -> list[dict]:
    """Pages of an M-tree over ``points``; page 0 is the root."""
    pages: list[dict] = []

    def grow(rows: np.ndarray, centre: np.ndarray, to_parent: float) -> int:
        away = distances(points[rows], centre)
        page = {"centre": centre, "radius": float(away.max()), "to_parent": to_parent, "rows": rows, "away": away,
                "children": []}
        pages.append(page)
        number = len(pages) - 1
        if len(rows) <= LEAF:
            return number
        # pivots: farthest-first from the routing point
        pivots, near = [], np.full(len(rows), np.inf)
        nearest = np.zeros(len(rows), int)
        at = int(away.argmax())
        for i in range(FAN_OUT):
            pivots.append(rows[at])
            d = distances(points[rows], points[rows[at]])
            closer = d < near
            near[closer], nearest[closer] = d[closer], i
            at = int(near.argmax())
            if near[at] == 0:
                break
        if len(pivots) == 1 or near.max() == 0 and len(pivots) < 2:
            groups = [rows[i:i + LEAF] for i in range(0, len(rows), LEAF)]   # equal points
        else:
            groups = [rows[nearest == i] for i in range(len(pivots))]
        page["rows"], page["away"] = rows[:0], away[:0]
        for i, group in enumerate(groups):
            if len(group):
                own = points[pivots[min(i, len(pivots) - 1)]]
                page["children"].append(grow(group, own, float(distances(own[None], centre)[0])))
        return number

    if len(points):
        grow(np.arange(len(points)), points[0], 0.0)
    return pages


def search(pages: list[dict], points: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int,
           least: float) -> list[tuple[int, int]]:
    """The k best (score, id) of one tree that are no worse than ``least``."""
    norm = float(np.sqrt((query.astype(float) ** 2).sum())) * (1 + 1e-9) + 1e-6
    best: list[tuple] = []        # heap of (score, -id)
    floor = least
    root = pages[0]
    product = above(query @ root["centre"])
    heap = [(-above(product + norm * root["radius"]), 0, product)]
    while heap:
        bound, number, product = heapq.heappop(heap)
        if -bound < floor:
            break
        page = pages[number]
        if page["children"]:
            for child in page["children"]:
                c = pages[child]
                if above(product + norm * (c["to_parent"] + c["radius"])) < floor:
                    continue
                inner = above(query @ c["centre"])
                limit = above(inner + norm * c["radius"])
                if limit >= floor:
                    heapq.heappush(heap, (-limit, child, inner))
            continue
        rows = page["rows"][np.nextafter(product + norm * page["away"], np.inf) >= floor]
        if not len(rows):
            continue
        scores = checked(points[rows] @ query)
        for i in np.flatnonzero(scores >= floor):
            name = int(ids[rows[i]])
            if name == own:
                continue
            entry = (int(scores[i]), -name)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
    return [(score, -name) for score, name in best]


def search_block(pages: list[dict], points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int,
                 least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search`` for a block of queries at once: (row of the query, id, score) of the k best of each.

    A page is met once, best first, with the queries whose bound of it reaches their floor, so
    that products are those of a block with a leaf.  For points whose products floats hold exactly.
    """
    norms = np.sqrt((queries ** 2).sum(1)) * (1 + 1e-9) + 1e-6
    floor, top = np.array(least, float), np.full((len(queries), k), -np.inf)
    held, found = 0, []

    def bounds(who, centre, radius):
        product = np.nextafter(queries[who] @ centre, np.inf)
        return product, np.nextafter(product + norms[who] * radius, np.inf)

    def best():
        who, names, scores = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((names, -scores, who))
        who, names, scores = who[order], names[order], scores[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        return who[place < k], names[place < k], scores[place < k]

    everyone = np.arange(len(queries))
    heap = [(0.0, 0, everyone, *bounds(everyone, pages[0]["centre"], pages[0]["radius"]))]
    while heap:
        _, number, who, product, limit = heapq.heappop(heap)
        live = limit >= floor[who]
        who, product, page = who[live], product[live], pages[number]
        if not len(who):
            continue
        if page["children"]:
            for child in page["children"]:
                c = pages[child]
                reach = np.nextafter(product + norms[who] * (c["to_parent"] + c["radius"]), np.inf) >= floor[who]
                asks = who[reach]
                if len(asks):
                    inner, limit = bounds(asks, c["centre"], c["radius"])
                    live = limit >= floor[asks]
                    if live.any():
                        heapq.heappush(heap, (-limit.max(), child, asks[live], inner[live], limit[live]))
            continue
        near = np.nextafter(product[:, None] + norms[who][:, None] * page["away"], np.inf) >= floor[who][:, None]
        cols = np.flatnonzero(near.any(0))
        rows = page["rows"][cols]
        scores = queries[who] @ points[rows].T
        hit = near[:, cols] & (scores >= floor[who][:, None]) & (ids[rows] != own[who][:, None])
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            continue
        at, col = np.nonzero(hit)
        found.append((who[at], ids[rows[col]], scores[at, col]))
        better = np.concatenate([top[who[some]], np.where(hit[some], scores[some], -np.inf)], 1)
        top[who[some]] = np.partition(better, better.shape[1] - k, axis=1)[:, -k:]
        floor[who[some]] = np.maximum(floor[who[some]], top[who[some]].min(1))
        held += len(at)
        if held > HELD:
            found = [best()]
            held = len(found[0][0])
    return best() if found else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row."""
    spark = vectors.sparkSession
    value = F.col(vector_col).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    points = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(value) > 0) & ~bad)
    points = staged(points.select(F.col(id_col).cast("long").alias("id"), value.alias("v"), queries.alias("asks"))
                    .groupBy("id").agg(F.min(F.struct("v", "asks")).alias("r"))
                    .select("id", F.col("r.v").alias("v"), F.col("r.asks").alias("asks"))
                    .withColumn("dim", F.size("v")), "points")
    count = points.groupBy("dim").count()
    trees = {r["dim"]: -(-r["count"] // TREE_POINTS) for r in count.collect()}   # a row for each length of vector
    blocks = {r["dim"]: -(-r["count"] // QUERY_BLOCK)
              for r in points.filter("asks").groupBy("dim").count().collect()}
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not blocks:
        return empty
    out = None
    for dim in sorted(blocks):
        own = points.filter(F.col("dim") == dim)
        found = _search_all(own, trees[dim], blocks[dim], k, scale)
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _search_all(points: DataFrame, trees: int, blocks: int, k: int, scale: float) -> DataFrame:
    spark = points.sparkSession
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = int((1 << 30) * min(1.0, PILOT / (trees * TREE_POINTS)))
    sample = points.filter(part < max(share, 1)).select("id", "v").toPandas()
    pilot_points = integer_points(sample["v"], scale) if len(sample) else np.zeros((0, 1))
    pilot = spark.sparkContext.broadcast((sample["id"].to_numpy(), pilot_points))

    def bounds(batches):
        names, known = pilot.value
        for rows in batches:
            least = np.full(len(rows), -np.inf)
            if len(names) > k and len(rows):
                q = integer_points(rows["v"], scale)
                if q.dtype != known.dtype:
                    q, known = exact(q), exact(known)
                scores = checked(q @ known.T)
                own = rows["id"].to_numpy()[:, None] == names[None, :]
                if scores.dtype == object:
                    least = np.array([at_most(sorted(s[~o])[-k]) for s, o in zip(scores, own)])
                else:
                    least = np.partition(np.where(own, -np.inf, scores), -k, axis=1)[:, -k]
            yield rows.assign(least=least)

    pages = points.select("id", "v", F.pmod(F.xxhash64(F.lit("tree"), "id"), F.lit(trees)).cast("int").alias("tree"))
    asked = points.filter("asks").select("id", "v").mapInPandas(
        bounds, "id long, v array<double>, least double").withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int"))
    forest = staged(pages.groupBy("tree").applyInPandas(
        _load(scale), "tree int, page int, centre int, radius double, to_parent double, children array<int>, "
        "ids array<long>, away array<double>, points array<array<double>>"), "mtree")
    left = forest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInPandas(
        _meet(k, scale), "query_id long, vec_id long, score long")


def _load(scale: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, raw = rows["id"].to_numpy(), list(rows["v"])
        points = integer_points(rows["v"], scale)
        pages = build(points)
        index = {p.tobytes() if p.dtype != object else tuple(p): i for i, p in reversed(list(enumerate(points)))}
        centre = [index[p["centre"].tobytes() if points.dtype != object else tuple(p["centre"])] for p in pages]
        return pd.DataFrame({
            "tree": rows["tree"].iloc[0], "page": range(len(pages)), "centre": [int(ids[c]) for c in centre],
            "radius": [p["radius"] for p in pages], "to_parent": [p["to_parent"] for p in pages],
            "children": [p["children"] for p in pages], "ids": [ids[p["rows"]] for p in pages],
            "away": [p["away"] for p in pages], "points": [[raw[i] for i in p["rows"]] for p in pages]})
    return run


def _meet(k: int, scale: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            left = left.sort_values("page")
            ids = np.concatenate([np.asarray(x, np.int64) for x in left["ids"]])
            points = integer_points(pd.Series([p for leaf in left["points"] for p in leaf]), scale)
            at = {name: i for i, name in enumerate(ids.tolist())}
            pages, begin = [], 0
            for r in left.itertuples():
                pages.append({"centre": points[at[r.centre]], "radius": r.radius, "to_parent": r.to_parent,
                              "children": [int(c) for c in r.children], "away": np.asarray(r.away, float),
                              "rows": np.arange(begin, begin + len(r.ids))})
                begin += len(r.ids)
            asked = integer_points(right["v"], scale)
            if asked.dtype != points.dtype:
                asked, points = exact(asked), exact(points)
                for p, centre in zip(pages, left["centre"]):
                    p["centre"] = points[at[centre]]
            if points.dtype != object:
                names = right["id"].to_numpy()
                who, others, scores = search_block(pages, points, ids, asked, names, k, right["least"].to_numpy(float))
                return pd.DataFrame({"query_id": names[who], "vec_id": others, "score": scores}).astype("int64")
            for name, q, least in zip(right["id"].tolist(), asked, right["least"]):
                rows += [(name, other, score) for score, other in search(pages, points, ids, q, name, k, least)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def exact(points: np.ndarray) -> np.ndarray:
    return points if points.dtype == object else np.array([[int(x) for x in r] for r in points], object)
