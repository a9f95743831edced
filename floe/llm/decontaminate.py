"""Benchmark decontamination as a prefix-filtered set join (native).

Every benchmark item is cut into windows of ``window`` consecutive words; a
shorter item is one window.  A window is a set of placed shingles (``shingle``
words at an offset, fewer for a shorter window).  Documents hold a window where
at least ``threshold`` of its shingles stand at their own places.

* Order: the shingles of a window are ordered by how often they occur in the
  documents (counted in a first pass, at most one row a benchmark shingle).
* Prefix: of n shingles ceil(threshold * n) must match, so a place that holds the
  window matches at least one of its n - ceil(threshold * n) + 1 rarest ones.
  Only these are joined with the documents' shingles.
* Length and position: a match of the shingle at offset o of a window of w words
  at document position p can only stand at p - o, and p - o + w words must exist.
* Verification compares the words themselves over the item-sized window.

The join keeps a document's words in the row that streams past the benchmark's
prefix table, so documents are not shuffled.  That table is broadcast only while
it has at most ``BROADCAST_ROWS`` rows; beyond, (document, position, shingle) rows
are joined by a shuffle and the candidates are verified by a second join.

Defined results: a null, empty or wordless text or item has no words, hits
nothing and is never contaminated; rows alike in doc_id and text are one document
with one row; items that repeat an item_id count once; items with a null item_id
are left out of ``contamination`` as in its query's SQL (``nameless`` takes them), but
``drop_contaminated`` drops their passages too.  Empty documents give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floe.llm.common import ascii_lower, staged

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def _key(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + i) for i in range(size)])


def benchmark_windows(benchmark: DataFrame, window: int, min_words: int,
                      nameless: bool = False) -> tuple[DataFrame, DataFrame]:
    """(windows: pid, pw, len), (owners: pid, item_id); with ``nameless`` also windows of items without item_id."""
    items = (benchmark if nameless else benchmark.filter("item_id is not null")).select(
        F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    cut = items.filter(F.size("w") >= max(min_words, 1)).select(
        "item_id", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    rows = staged(cut.select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("pw")).withColumn(
        "pid", F.sha2(F.concat_ws(" ", "pw"), 256)).distinct(), "windows")
    return rows.select("pid", "pw", "len").distinct(), rows.select("pid", "item_id").filter(
        "item_id is not null").distinct()


def _placed(windows: DataFrame, shingle: int) -> DataFrame:
    """(pid, pw, len, size, off, key) for every shingle of every window."""
    rows = windows.withColumn("size", F.least("len", F.lit(shingle))).withColumn(
        "off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))))
    key = F.lit(None).cast("long")
    for n in range(1, shingle + 1):
        key = F.when(F.col("size") == n, _key("pw", F.col("off"), n)).otherwise(key)
    return rows.withColumn("key", key)


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row for each document word (and size): doc_id, h, words, n_words, pos, nth, key."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "h", "words", F.posexplode_outer("words").alias("pos", "word")).withColumn(
        "n_words", F.size("words"))
    keys = [F.when(F.col("pos") + n <= F.col("n_words"), _key("words", F.col("pos"), n)) for n in sizes]
    if len(keys) == 1:
        return rows.select("doc_id", "h", "words", "n_words", "pos", F.lit(0).alias("nth"), keys[0].alias("key"))
    return rows.select("doc_id", "h", "words", "n_words", "pos", F.posexplode(F.array(*keys)).alias("nth", "key"))


def _holds(threshold: float) -> Column:
    start = F.col("pos") - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    here = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len"))
    if threshold >= 1:
        return inside & (here == F.col("pw"))
    places = F.sequence(F.lit(1), F.col("len") - F.col("size") + 1)
    same = F.size(F.filter(places, lambda i: F.slice(here, i, F.col("size")) == F.slice("pw", i, F.col("size"))))
    return inside & (same >= F.col("need"))


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, h, n_words, start, len, pid): all held windows, and a row without them for each document."""
    placed = staged(_placed(windows, shingle), "placed")
    sizes = sorted(r[0] for r in placed.select("size").distinct().collect()) or [shingle]   # 1..shingle
    keys = staged(placed.select(F.col("key").alias("k")).distinct(), "keys")
    few = keys.count() <= BROADCAST_ROWS
    spread = _positions(docs, sizes)
    seen = spread.filter("key is not null").select("key").join(
        F.broadcast(keys) if few else keys, F.col("key") == F.col("k")).groupBy("key").agg(
            F.count(F.lit(1)).alias("often"))
    ranked = placed.join(staged(seen, "often"), "key", "left").withColumn(
        "nth_rarest", F.row_number().over(Window.partitionBy("pid").orderBy(
            F.coalesce("often", F.lit(0)), "key", "off"))).withColumn(
        "total", F.col("len") - F.col("size") + 1).withColumn(
        "need", F.ceil(F.lit(float(threshold)) * F.col("total")).cast("int"))
    # a shingle that no document has can't be matched: such rows need not travel
    prefix = staged(ranked.filter("nth_rarest <= total - need + 1 and often is not null").select(
        F.col("key").alias("k"), "pid", "pw", "len", "size", "off", "need"), "prefix")
    start = (F.col("pos") - F.col("off")).alias("start")
    if prefix.count() <= BROADCAST_ROWS:
        met = spread.join(F.broadcast(prefix), (F.col("key") == F.col("k")) & _holds(threshold), "left")
        return staged(met.filter("pid is not null or (nth = 0 and coalesce(pos, 0) = 0)").select(
            "doc_id", "h", "n_words", start, "len", "pid"), "met")
    narrow = spread.filter("key is not null").select("doc_id", "h", "pos", "key")
    candidates = narrow.join(prefix.select("k", "pid", "off"), F.col("key") == F.col("k")).select(
        F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "pos", "off", "pid").distinct()
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words")).withColumn(
        "n_words", F.size("words"))
    held = candidates.join(words, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h"))).join(
        prefix.select("pid", "pw", "len", "size", "need").distinct(), "pid").filter(_holds(threshold))
    nothing = [F.lit(None).cast(t) for t in ("int", "int", "string")]
    return staged(held.select("doc_id", "h", "n_words", start, "len", "pid").union(
        words.select("doc_id", "h", "n_words", *nothing)), "met")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5,
                  threshold: float = 1.0, min_words: int = 1, nameless: bool = False) -> DataFrame:
    """(doc_id, h, n_words, n_hit, items: sorted item_ids as text) for every document."""
    windows, owners = benchmark_windows(benchmark, window, min_words, nameless)
    met = occurrences(docs.select("doc_id", "text"), windows, shingle, threshold)
    base = met.groupBy("doc_id", "h").agg(F.max("n_words").cast("long").alias("n_words"))
    hits = met.filter("pid is not null")
    covered = hits.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.explode(
        F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy(
            "_d", "_h").agg(F.count(F.lit(1)).alias("n_hit"))
    if owners.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    named = hits.select(F.col("doc_id").alias("_d2"), F.col("h").alias("_h2"), "pid").distinct().join(
        owners, "pid").groupBy("_d2", "_h2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = base.join(covered, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    out = out.join(named, F.col("doc_id").eqNullSafe(F.col("_d2")) & (F.col("h") == F.col("_h2")), "left")
    return out.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def mostly_short_items(docs: DataFrame, benchmark: DataFrame, min_words: int, shingle: int = 5) -> DataFrame:
    """(doc_id, h) of documents of which more than half of the words are one item of fewer than ``min_words`` words."""
    short = benchmark.filter(F.size(words_of(F.col("text"))).between(1, min_words - 1))
    windows, _ = benchmark_windows(short, max(min_words - 1, 1), 1, nameless=True)
    met = occurrences(docs.select("doc_id", "text"), windows, shingle, 1.0).filter("pid is not null")
    places = met.select("doc_id", "h", "n_words", "pid", F.explode(
        F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct()
    return places.groupBy("doc_id", "h", "pid").agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words")).filter(
        "2 * n > n_words").select("doc_id", "h").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns.

    Items of fewer than ``min_words`` words occur in clean text, so they mark only documents
    that consist mostly of one of them.
    """
    found = contamination(docs, benchmark, min_words=min_words, **{"nameless": True, **options}).filter(
        "n_hit > 0").select("doc_id", "h")
    if not benchmark.filter(F.size(words_of(F.col("text"))).between(1, min_words - 1)).isEmpty():
        found = found.union(mostly_short_items(docs, benchmark, min_words, options.get("shingle", 5))).distinct()
    bad = staged(found.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_h"]), "left_anti")
