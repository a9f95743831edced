"""MinHash near-dedup with SuperMinHash signatures.

1. A document's words become distinct shingles of ``shingle`` words (64-bit
   hashes).  Documents with the same set form one class at once, by a digest of
   the set, so thousands of copies cost one class.
2. SuperMinHash: each element draws a random permutation of the slots and a
   value in [j, j+1) at its j-th slot.  Values of one level are all smaller than
   those of the next, so levels are processed one after another over all
   elements of a batch, and a document stops as soon as its slots are filled.
   Slots of one document are correlated, which lowers the variance against
   independent hashes.
3. ``rows`` slots make a band.  Classes that share a band value meet.  A pair at
   the threshold is missed by all bands with probability (1 - t^rows)^bands:
   3e-6 for 0.8 and 7e-9 for 0.85 with 5 rows and 32 bands.
4. Candidates are confirmed on their whole shingle sets, in two rounds (pairs that a
   profile of 128 counts rules out don't travel with their sets), and no list of all pairs of a large bucket is made.  First all members of a bucket meet its
   pivot: the one with most company over all its buckets, of many edited copies the
   one they were made from.  Buckets whose members are then in one component are
   done.  In the others, members of different components meet: pair by pair in
   buckets of at most ``SMALL_BUCKET``, block against block in larger ones.  So no
   link between components is lost.
5. Components by union-find in tasks and star contraction across them.

Defined results: a text that is null, empty or blank has an empty set and is
linked with nothing; a text shorter than a shingle is one shingle; rows that
share a doc_id are one document; rows without doc_id take part, and a component
of such rows only has a null component_id.  Ids may be numbers or texts.  Without
documents: no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.llm.common import finished, released, staged, sweep, word_numbers, worker_table
from floe.llm.components import components, roots_of

BATCH_ELEMENTS = 1 << 15
ROWS = 512                     # of a batch whose sets are held at once
SMALL_BUCKET, BLOCK, COLUMNS = 32, 256, 4_096
BLOCK_ELEMENTS = 500_000       # shingles of a block
WORD_BITS, BITS_EACH = 1 << 15, 32
MOST_BITS = 1 << 26            # of a bitmap of key hashes, 8 MB


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str | None, size: int, cache: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_numbers(words, cache, np.uint64, lambda fresh: list(map(word_hash, fresh)))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        out = mix(out ^ h[i:len(h) - size + 1 + i]) + np.uint64(i)
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (len(sets) x slots) of non-empty sets, all elements level by level."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets)
    low = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    drawn: list[np.ndarray] = []
    for j in range(slots):
        r = mix(elements ^ mix(np.full(1, j, np.uint64))[0])
        k = (j + ((r >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int64)).astype(np.int16)
        slot = k.copy()
        # the slot that the swaps of the levels before have put at place k
        for i in range(j - 1, -1, -1):
            np.copyto(slot, i, where=slot == drawn[i])
        drawn.append(k)
        value = (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF))
        np.minimum.at(low, of * slots + slot, value)
        full = (low.reshape(len(sets), slots) < np.uint64((j + 1) << 32)).all(1)
        if full.all():
            break
        active = ~full[of]
        if not active.all():
            of, elements = of[active], elements[active]
            drawn = [d[active] for d in drawn]
    return low.reshape(len(sets), slots)


def band_keys(sets: list[np.ndarray], rows: int, bands: int) -> list[np.ndarray]:
    """One int64 a band for each set; documents go through in batches of bounded size."""
    out: list[np.ndarray] = []
    begin, held = 0, 0
    for i, s in enumerate(sets):
        held += max(len(s), 64)
        if held >= BATCH_ELEMENTS or i == len(sets) - 1:
            sig = super_minhash(sets[begin:i + 1], rows * bands).reshape(-1, bands, rows)
            key = np.full(sig.shape[:2], np.uint64(0))
            for r in range(rows):
                key = mix(key ^ sig[:, :, r])
            out += list(key.view(np.int64))
            begin, held = i + 1, 0
    return out


def _signatures(shingle: int, rows: int, bands: int):
    """Arrow batches (doc_id, text) to (doc_id, n, digest, bands); ids of any type pass through as they are."""
    def run(batches):
        cache = worker_table("shingles")
        for part in released(batches):
            for at in range(0, part.num_rows, ROWS):
                piece = part.slice(at, ROWS)
                sets = [shingle_set(t, shingle, cache) for t in piece.column("text").to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = dict(zip(some, band_keys([sets[i] for i in some], rows, bands)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_digest(s) for s in sets], pa.binary()),
                     pa.array([keys.get(i) for i in range(len(sets))], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "bands"])
    return run


def _slices(batches):
    for part in released(batches):
        for at in range(0, len(part), ROWS):
            yield part.iloc[at:at + ROWS]


def set_digest(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def profile(items: np.ndarray) -> bytes:
    """How many shingles fall into each of 128 parts of the hash range, 255 standing for that many or more."""
    return np.minimum(np.bincount((items >> np.uint64(57)).astype(np.int64), minlength=128), 255).astype(np.uint8).tobytes()


def _sets(shingle: int):
    def run(batches):
        cache = worker_table("shingles")
        for part in _slices(batches):
            sets = [shingle_set(t, shingle, cache) for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "items": [s.tobytes() for s in sets], "profile": list(map(profile, sets))})
    return run


def _digested_sets(shingle: int):
    def run(batches):
        cache = worker_table("shingles")
        for part in _slices(batches):
            sets = [s for s in (shingle_set(t, shingle, cache) for t in part["text"]) if len(s)]
            yield pd.DataFrame({"digest": [set_digest(s) for s in sets], "items": [s.tobytes() for s in sets],
                                "profile": list(map(profile, sets))})
    return run


def _possible(percent: int):
    """Pairs whose profiles allow the similarity: no set shares more with another than their lesser counts."""
    def run(batches):
        for part in released(batches):
            a, b = (np.frombuffer(b"".join(part[c]), np.uint8).reshape(-1, 128) for c in ("x", "y"))
            most = np.minimum(a, b).sum(1, dtype=np.int64)
            sizes = a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
            open_ = (a == 255).any(1) | (b == 255).any(1)
            yield part.loc[open_ | (100 * most >= percent * (sizes - most)), ["u", "v"]]
    return run


def _verify(percent: int):
    def run(batches):
        for part in released(batches):
            ok = np.zeros(len(part), bool)
            for i, (a, b) in enumerate(zip(part["x"], part["y"])):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield part.loc[ok, ["u", "v"]]
    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 5,
                    bands: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; doc_id of any type that has an order."""
    return finished(docs.sparkSession, "groups", lambda: _groups(docs, shingle, percent, rows, bands))


def _classes(docs: DataFrame, kind: str, shingle: int, rows: int, bands: int) -> list[DataFrame]:
    """Rows (doc_id, n, digest), and the distinct sets (id, digest, low, n, bands)."""
    signed = staged(docs.select("doc_id", "text").mapInArrow(
        _signatures(shingle, rows, bands), f"doc_id {kind}, n long, digest binary, bands array<long>"), "signed")
    grouped = staged(signed.filter("digest is not null").groupBy("digest").agg(
        F.min(F.struct("n", "bands")).alias("c"), F.min("doc_id").alias("low")), "grouped")
    # numbered once written: a class is known by its whole digest, its number is only short
    return [signed.drop("bands"), grouped.select(
        F.monotonically_increasing_id().alias("id"), "digest", "low", F.col("c.n").alias("n"),
        F.col("c.bands").alias("bands"))]


def _groups(docs: DataFrame, shingle: int, percent: int, rows: int, bands: int) -> DataFrame:
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    signed, classes = finished(docs.sparkSession, "classes", lambda: _classes(docs, kind, shingle, rows, bands))
    full = signed.filter("digest is not null")
    rows, ids, nameless = signed.agg(F.count("doc_id"), F.countDistinct("doc_id"),
                                     F.count(F.when(F.col("doc_id").isNull() & F.col("digest").isNotNull(), 1))).first()
    links = docs.sparkSession.createDataFrame([], "u long, v long")
    if rows > ids:
        # rows that share a doc_id are one document, so they tie their classes together
        tied = staged(full.filter("doc_id is not null").select("doc_id", "digest").distinct().join(
            classes.select("digest", "id"), "digest").select("doc_id", "id"), "tied")
        first = tied.groupBy("doc_id").agg(F.min("id").alias("v"))
        links = staged(tied.join(first, "doc_id").select(F.col("id").alias("u"), "v").filter("u <> v"), "links")
    roots = _class_roots(docs, classes, links, shingle, percent, nameless > 0 or rows > ids)
    comps = staged(classes.select("id", "digest", "low").join(roots, F.col("id") == F.col("node"), "left").select(
        "id", "digest", "low", F.coalesce("root", "id").alias("root")), "comps")
    names = comps.groupBy("root").agg(F.min("low").alias("component_id"), F.min("id").alias("first"))
    named = staged(comps.join(names, "root").select("digest", "component_id", (F.col("id") == F.col("first")).alias("leads")),
                   "named")
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left")
    comp = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    # rows without doc_id: of a component without ids the rows of its first class stay
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == comp).otherwise(
        F.col("digest").isNull() | (F.col("component_id").isNull() & F.col("leads")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), kept.alias("kept"))


def _whole_sets(docs: DataFrame, chosen: DataFrame, shingle: int, by_digest: bool) -> DataFrame:
    """(id, items) of the classes in ``chosen``, from the text of one of their documents."""
    if not by_digest:
        named = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_low"))
        return named.select(F.col("_id").alias("id"), "text").mapInPandas(
            _sets(shingle), "id long, items binary, profile binary")
    # ids don't name texts here: find a class by its digest
    found = docs.select("text").mapInPandas(_digested_sets(shingle), "digest binary, items binary, profile binary")
    return found.join(chosen, F.col("digest") == F.col("_digest")).groupBy(F.col("_id").alias("id")).agg(
        F.min(F.struct("items", "profile")).alias("s")).select("id", "s.items", "s.profile")


def _starred(classes: DataFrame) -> DataFrame:
    """(bucket, size, pid, pn, id, n): the members of every bucket of two or more, with its pivot."""
    exploded = classes.select(F.col("id"), F.col("n"), F.posexplode("bands").alias("band", "value"))
    shared = exploded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # what a hot bucket is joined with is written first: adaptive execution then can split its rows
    shared = staged(shared, "shared")
    rest = staged(exploded.join(shared, ["band", "value"])
                  .select(F.xxhash64("band", "value").alias("bucket"), "id", "n", "members"), "members")
    met = rest.groupBy("id").agg(F.sum("members").alias("weight"))
    rest = staged(rest.drop("members").join(met, "id"), "weighed")
    sweep(classes.sparkSession)
    pivots = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max(
        F.struct("weight", (-F.col("id")).alias("minus"), "n")).alias("p")).select(
            "bucket", "size", (-F.col("p.minus")).alias("pid"), F.col("p.n").alias("pn"))
    return rest.select("bucket", "id", "n").join(staged(pivots, "pivots"), "bucket")


def _class_roots(docs: DataFrame, classes: DataFrame, links: DataFrame, shingle: int, percent: int,
                 by_digest: bool) -> DataFrame:
    spark = docs.sparkSession
    rest = finished(spark, "starred", lambda: _starred(classes))
    chosen = staged(classes.join(rest.select(F.col("id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_semi").select(
        F.col("id").alias("_id"), F.col("low").alias("_low"), F.col("digest").alias("_digest")), "chosen")
    sets = staged(_whole_sets(docs, chosen, shingle, by_digest), "sets")
    sweep(spark)
    # first round: everyone against the pivot of each bucket
    close = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    pairs = rest.filter(close & (F.col("id") != F.col("pid"))).select(
        F.greatest("id", "pid").alias("u"), F.least("id", "pid").alias("v"))
    links = staged(links.union(_confirmed(pairs, sets, percent)), "links")
    sweep(docs.sparkSession)
    comp = components(links)
    # second round: what is still apart within a bucket
    open_ = staged(rest.join(comp, F.col("id") == F.col("node"), "left").select(
        "bucket", "size", "pid", "id", "n", F.coalesce("root", "id").alias("comp")), "labelled")
    apart = open_.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter(
        "lo <> hi").select("bucket")
    open_ = staged(open_.join(staged(apart, "apart"), "bucket"), "open")
    sweep(docs.sparkSession)
    small, large = open_.filter(F.col("size") <= SMALL_BUCKET), open_.filter(F.col("size") > SMALL_BUCKET)
    other = small.select("bucket", F.col("id").alias("v"), F.col("n").alias("pn"), F.col("comp").alias("vcomp"))
    pairs = small.join(other, "bucket").filter(
        (F.col("id") > F.col("v")) & (F.col("comp") != F.col("vcomp")) & close).select(
            F.col("id").alias("u"), "v")
    found = _confirmed(pairs, sets, percent).union(_block_links(large, sets, percent))
    known = comp.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(staged(known.union(found), "links"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough.

    Profiles of 128 bytes go first: what they leave, a small part, is sent with whole sets.
    """
    pairs = staged(pairs.distinct(), "pairs")
    sweep(pairs.sparkSession)
    likely = staged(_beside(pairs, sets.select("id", "profile"), "profile").mapInPandas(
        _possible(percent), "u long, v long"), "likely")
    named = staged(likely.select(F.col("u").alias("_n")).union(likely.select("v")).distinct(), "named_sets")
    own = sets.select("id", "items").join(named, F.col("id") == F.col("_n"), "left_semi")
    return _beside(likely, own, "items").mapInPandas(_verify(percent), "u long, v long")


def _beside(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """(u, v, x, y): the value ``name`` of both sides of every pair."""
    left = pairs.join(values.select(F.col("id").alias("_a"), F.col(name).alias("x")), F.col("u") == F.col("_a"))
    both = left.join(values.select(F.col("id").alias("_b"), F.col(name).alias("y")), F.col("v") == F.col("_b"))
    return both.select("u", "v", "x", "y")


def _block_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside large buckets, block against block.

    Buckets of one pivot hold mostly the same classes, so they are one group.
    Its classes are dealt into blocks of bounded rows and shingles; each pair of blocks is one group.
    """
    group = large.select("pid", "id", "n", "comp").distinct()
    many = group.groupBy("pid").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_ELEMENTS))
                                    .cast("int").alias("blocks"))
    dealt = group.join(staged(many, "groups"), "pid").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "comp")
    named = staged(group.select(F.col("id").alias("_n")).distinct(), "named_sets")
    own = sets.join(named, F.col("id") == F.col("_n"), "left_semi").select(F.col("id").alias("_s"), "items")
    full = sent.join(own, F.col("id") == F.col("_s")).drop("_s")
    return full.groupBy("pid", "i", "j").applyInPandas(_similar_in_block(percent), "u long, v long")


def _similar_in_block(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        sizes = np.array([len(x) for x in sets])
        of = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        of, column = of[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[of[a:b], column[a:b] - low] = 1
            both += part @ part.T
        comp, ids = rows["comp"].to_numpy(), rows["id"].to_numpy()
        together = both.astype(np.int64)
        good = 100 * together >= percent * (sizes[:, None] + sizes[None, :] - together)
        u, v = np.nonzero(np.triu(good & (comp[:, None] != comp[None, :]), 1))
        if not len(u):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        nodes, root = roots_of(ids[u], ids[v])
        return pd.DataFrame({"u": nodes, "v": root})[nodes != root]
    return run


def _parted(docs: DataFrame, asked: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose key is surely not in ``asked``, and the others: all that are and some that are not.

    A bitmap of key hashes tells them apart where they lie, so that only the others, some three per
    cent more than are asked for, go through a shuffle with their texts.  It has at most ``MOST_BITS``
    bits: for more than two million keys more rows go, in the end all.
    """
    bits = min(MOST_BITS, max(WORD_BITS, 1 << (BITS_EACH * asked.count()).bit_length()))
    word, at, bitmap = (f"{name}_{uuid.uuid4().hex}" for name in ("word", "at", "bitmap"))
    slot = F.pmod(F.xxhash64(*key), F.lit(bits))
    place = {word: F.shiftright(slot, 15), at: slot % WORD_BITS}
    marks = staged(asked.withColumns(place).groupBy(word).agg(F.bitmap_construct_agg(at).alias(bitmap)), "marks")
    met = docs.withColumns(place).join(F.broadcast(marks), word, "left")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    return met.filter(~hit).drop(word, at, bitmap), met.filter(hit).drop(word, at, bitmap)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near copies stays, the one of the smallest doc_id.  Columns as in ``docs``.

    Where doc_id is repeated or null, rows are told apart by it and a hash of their text:
    different texts of one doc_id go by their own groups, rows without doc_id stay only
    where no row with one does, and texts without words are dropped only as repeats.
    """
    rows, ids = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if rows == ids:
        found = near_duplicates(docs.select("doc_id", "text"), **options)
        gone = staged(found.filter("not kept").select("doc_id"), "gone")
        own, others = _parted(docs, gone, ["doc_id"])
        gone = gone.withColumnRenamed("doc_id", "_gone")
        return own.union(others.join(gone, others["doc_id"] == gone["_gone"], "left_anti"))
    name = f"h_{uuid.uuid4().hex}"
    keyed = docs.withColumn(name, F.when(docs["text"].isNull(), F.lit("-")).otherwise(F.md5(docs["text"])))
    found = finished(docs.sparkSession, "found", lambda: near_duplicates(staged(
        keyed.select(F.col(name).alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts"), **options).select(
            F.col("doc_id").alias("_text"), "n_shingles", "component_id"))
    met = keyed.select("doc_id", F.col(name).alias("h")).join(found, F.col("h") == F.col("_text"))
    first = met.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("m")).select("m.doc_id", "m.h")
    kept = staged(first.union(met.filter("n_shingles = 0").select("doc_id", "h").distinct()).select(
        F.col("doc_id").alias("_kept"), F.col("h").alias("_h")), "kept")
    # what stays and stands there once needn't travel
    counted = keyed.groupBy("doc_id", name).agg(F.count(F.lit(1)).alias("_times"))
    asked = staged(counted.join(kept, counted["doc_id"].eqNullSafe(kept["_kept"]) & (counted[name] == kept["_h"]), "left").filter(
        "_times > 1 or _h is null").select("doc_id", name), "asked")
    own, others = _parted(keyed, asked, ["doc_id", name])
    some = others.join(kept, others["doc_id"].eqNullSafe(kept["_kept"]) & (others[name] == kept["_h"]), "left_semi")
    return own.union(some.dropDuplicates(["doc_id", name])).drop(name)
