"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import time
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floe.session import Scope, scratch_path

TABLE_BYTES = 40 << 20     # of words a Python worker keeps
ENTRY_BYTES = 120          # of a table's entry beside its word
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.

    It does so when the driver collects garbage, which a driver with little to do does rarely.
    What the first collection sets free, the second one finds.
    """
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.2)


def finished(spark: SparkSession, name: str, build: Callable[[], DataFrame | list[DataFrame]]) -> DataFrame | list[DataFrame]:
    """The frame or frames that ``build`` makes, written below the shared folder; what was staged on the way is removed."""
    written = []
    with Scope(spark) as scope:
        made = build()
        for part in made if isinstance(made, list) else [made]:
            written.append((part.schema, path := scratch_path(spark, name)))
            part.write.parquet(path)
        alone = not isinstance(made, list)
        del made, part
        scope.give([path for _, path in written])
    sweep(spark)
    frames = [spark.read.schema(schema).parquet(path) for schema, path in written]
    return frames[0] if alone else frames


def give_back() -> None:
    """Return memory that Arrow and the allocator hold unused, so that a Python worker holds one batch's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterable) -> Iterator:
    """The batches; memory goes back after each."""
    for part in batches:
        yield part
        del part
        give_back()


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")),
                  F.lit(modulus))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int,
                    max_rows: int, columns: list[str]) -> list[tuple]:
    """Rows (label, *columns) of labelled documents whose remainder is not ``held``.

    At most about ``max_rows`` rows (expected number), chosen by a hash of the
    id.  Repeated labels of a document are averaged; a null label is no label.
    The sampled labels are bounded by ``max_rows``, hence the broadcast.
    """
    known = (labels.select(F.col("doc_id").alias("_l_id"), F.col(label).cast("double").alias("_l_y"))
             .filter(F.col("_l_id").isNotNull() & F.col("_l_y").isNotNull()
                     & (remainder(F.col("_l_id"), modulus) != held))
             .groupBy("_l_id").agg((F.avg("_l_y") >= 0.5).cast("int").alias("_l_y")))
    total = known.count()
    if not total:
        return []
    parts = 1 << 30
    keep = parts if total <= max_rows else int(parts * max_rows / total)
    chosen = known.filter(F.pmod(F.xxhash64("_l_id"), F.lit(parts)) < keep)
    rows = (docs.select("doc_id", *columns).join(F.broadcast(chosen), F.col("doc_id") == F.col("_l_id"))
            .select("_l_y", "doc_id", *columns).collect())
    # sorted, so that a fit doesn't depend on the order in which tasks end
    return [(r[0], *r[2:]) for r in sorted(rows, key=lambda r: (r[1], str(r[2:])))]


def word_numbers(words: list[bytes], table: dict, kind, learn: Callable[[list[bytes]], list]) -> np.ndarray:
    """The number of every word; ``learn`` gives those of words not in ``table``, which stays below ``TABLE_BYTES``."""
    try:
        return np.fromiter(map(table.__getitem__, words), kind, len(words))
    except KeyError:
        fresh = set(words).difference(table)
    held = table.get(None, 0)       # the bytes the table holds
    need = sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
    if held + need > TABLE_BYTES:
        table.clear()
        held, fresh = 0, set(words)
        need = sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
    names = list(fresh)
    learned = dict(zip(names, learn(names)))
    if need <= TABLE_BYTES:
        table.update(learned)
        table[None] = held + need
        learned = table
    return np.fromiter(map(learned.__getitem__, words), kind, len(words))


def worker_table(owner: str) -> dict:
    """The table of the Python worker: it keeps one, which goes when another owner asks."""
    holder = sys.modules.setdefault("_floe_worker", types.ModuleType("_floe_worker"))
    if getattr(holder, "owner", None) != owner:
        holder.owner, holder.table = owner, {}
    return holder.table
