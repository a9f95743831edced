"""Token-id output with bit-plane shuffling.

A file holds whole documents.  Its ids (unsigned 32-bit) are cut into blocks of
``BLOCK`` ids; a block is transposed into planes - 4 byte planes or 32 bit planes
- so that the mostly empty high planes and the alike low ones compress on their
own.  Layout, all numbers little-endian:

    "FBP1" | mode u32 (4 or 32 planes) | block u32 | n_ids u64 | n_docs u64
    | chunk index: compressed length of every plane of every block, u32
    | planes, zstandard each; length 0 stands for a plane of zeros

The document lengths (ids of each document) are the first blocks of the file,
coded the same way.  A block is found and decoded from the index alone.

Documents are dealt by ranges of doc_id and sorted inside them; each task encodes
its range as a stream and emits one row a file (partition, number in it, doc_ids,
file bytes).  Spark's Parquet writer stores the rows: it commits whole tasks, so a
lost executor leaves no half-written file, and it reaches every store that Spark
does.  Global starts come from the files' id counts, a running sum over
partitions and files, not over documents.

Defined results: a null text is empty (its end id only); repeated rows stay
separate rows; a null doc_id sorts first, ties are ordered by a hash of the text;
without documents there are no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floe.llm.common import released, staged, worker_table

MAGIC = b"FBP1"
BLOCK = 1 << 16
FILE_IDS = 1 << 20
PORTION = 8 << 20          # bytes of text that are encoded together
CACHE_PIECES = 500_000
TOGETHER = 2_000
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PARTED = r"([a-z])([!-/:-@\[-`{-~]+)([ \t-\r]|\z)"
HEAD = "<4sIIQQ"


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == 4:
        return [p.tobytes() if p.any() else b"" for p in by_byte]
    bits = np.unpackbits(by_byte[:, :, None], axis=2, bitorder="little")
    rows = np.packbits(bits.transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in rows]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        rows = [np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in parts]
        return np.ascontiguousarray(np.stack(rows, 1)).view("<u4").ravel()
    out = np.zeros(n, np.uint32)
    for i, p in enumerate(parts):
        if p:
            bits = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
            out |= bits.astype(np.uint32) << np.uint32(i)
    return out


def _blocks(n: int, block: int) -> list[tuple[int, int]]:
    return [(a, min(a + block, n)) for a in range(0, n, block)]


def encode_file(lengths: np.ndarray, ids: np.ndarray, planes: int = 4, block: int = BLOCK, level: int = 3) -> bytes:
    pack = zstandard.ZstdCompressor(level=level)
    chunks = [pack.compress(p) if p else b"" for numbers in (lengths, ids)
              for a, b in _blocks(len(numbers), block) for p in to_planes(numbers[a:b], planes)]
    index = np.array([len(c) for c in chunks], "<u4").tobytes()
    return b"".join([struct.pack(HEAD, MAGIC, planes, block, len(ids), len(lengths)), index, *chunks])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids)."""
    magic, planes, block, n_ids, n_docs = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a bit-plane file")
    spans = [_blocks(n_docs, block), _blocks(n_ids, block)]
    index = np.frombuffer(data, "<u4", planes * sum(map(len, spans)), struct.calcsize(HEAD))
    ends = struct.calcsize(HEAD) + index.nbytes + np.cumsum(index, dtype=np.int64)
    unpack, at, out = zstandard.ZstdDecompressor(), 0, []
    for span in spans:
        parts = []
        for a, b in span:
            planes_of = [unpack.decompress(data[ends[i] - index[i]:ends[i]]) if index[i] else b""
                         for i in range(at, at + planes)]
            at += planes
            parts.append(from_planes(planes_of, b - a))
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
    return out[0], out[1]


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's splitting rule never joins characters across white space and
    it lower-cases, so the ids of a text are those of its white-space separated
    pieces in order.  Arrow cuts a batch into pieces and finds its distinct ones, a worker
    asks the library once for each piece it meets, and numpy puts the ids together.
    Texts that may hold a special token's string are encoded in one go.

    Known pieces are kept in two tables of at most ``CACHE_PIECES``: when the younger is
    full it becomes the older one, from which pieces still in use come back.

    The library composes before it lower-cases: W and a ring stay two characters, w and a
    ring become one.  So texts with combining marks of U+0300 to U+037F keep their case here.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = worker_table(f"pieces {path}")
        self.pieces = self.kept.setdefault("young", {})
        self.letters: dict[str, bool] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ask(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; many go through the library as one text and are told apart by their offsets."""
        out: list[bytes] = []
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at:at + TOGETHER]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(p) + 1 for p in part])
            raw = np.array(e.ids, "<u4").tobytes()
            begin = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            ends = np.searchsorted(begin, starts[1:]) * 4
            out += [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        return out

    def _apart(self, last: str) -> bool:
        """Whether the library itself parts punctuation from the letter ``last``; some become letter and mark."""
        if last not in self.letters:
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(last + "."))
            self.letters[last] = last.isalpha() and parts[-1][0] == "."
        return self.letters[last]

    def _learn(self, pieces: set[bytes]) -> None:
        """Fill the table; punctuation after a last letter is a piece of its own."""
        known, stem = self.pieces, {}
        for p in pieces:
            s = p.rstrip(MARKS)
            if 0 < len(s) < len(p) and (97 <= s[-1] <= 122 or self._apart(s.decode()[-1])):
                stem[p] = s
        fresh = list({x for p in pieces for x in ((stem[p], p[len(stem[p]):]) if p in stem else (p,))}.difference(known))
        known.update(zip(fresh, self._ask([x.decode() for x in fresh])))
        known.update((p, known[s] + known[p[len(s):]]) for p, s in stem.items())

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        old = self.kept.get("old", {})
        fresh = set()
        for p in pieces:
            if p not in self.pieces:
                if p in old:
                    self.pieces[p] = old[p]
                else:
                    fresh.add(p)
        if fresh:
            self._learn(fresh)
        known = [self.pieces[p] for p in pieces]
        if len(self.pieces) > CACHE_PIECES:
            self.kept["old"], self.pieces = self.pieces, {}
            self.kept["young"] = self.pieces
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        # copied, so that its offsets start at 0: kernels misread a slice of another width
        texts = pa.concat_arrays([pa.array([], pa.string()), pc.fill_null(texts.cast(pa.string()), "")])
        whole = pc.match_substring(texts, "<|")
        lowered = pc.if_else(self._marked(texts), texts, pc.ascii_lower(texts))
        # punctuation after a last ASCII letter is a piece of its own, as in _learn
        parted = pc.replace_substring_regex(pc.if_else(whole, "", lowered), PARTED, "\\1 \\2\\3")
        lists = pc.ascii_split_whitespace(parted)
        found = lists.flatten().dictionary_encode()
        known = self._known(found.dictionary.cast(pa.large_binary()).to_pylist())
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = found.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])
        ids = flat[place]
        offsets = lists.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False))[::-1]:
            own = np.frombuffer(self._whole(texts[int(i)].as_py()), "<u4")
            ids = np.insert(ids, bounds[i], own)
            bounds[i + 1:] += len(own)
        return ids, np.diff(bounds)

    @staticmethod
    def _marked(texts: pa.Array) -> pa.Array:
        """Whether a text holds a byte 0xCC or 0xCD, which begin U+0300 to U+037F."""
        marked = np.zeros(len(texts), bool)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        at = np.flatnonzero((held == 0xCC) | (held == 0xCD)) + offsets[0]
        marked[np.searchsorted(offsets, at, side="right") - 1] = True
        return pa.array(marked)

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        made, n = self.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        for a, b in zip((ends - n).tolist(), ends.tolist()):
            yield made[a:b].tobytes()


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of about ``PORTION`` bytes at a time."""
    for batch in released(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def write_files(docs: DataFrame, path: str, end_id: int = 2, planes: int = 4) -> DataFrame:
    """Rows (part, number, doc_ids, n_ids, file), one a file, read back from the shared folder."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = Encoder(path), TaskContext.get().partitionId(), 0
        names, parts, lengths, held = [], [], [], 0

        def file() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            own = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([len(ids)], pa.int64()),
                pa.array([encode_file(np.concatenate(lengths).astype(np.uint32), ids, planes)], pa.binary())],
                names=["part", "number", "doc_ids", "n_ids", "file"])

        for batch in _portions(batches):
            ids, n = encoder.encode(batch.column("text"))
            ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                # whole documents, up to the one that fills the file
                begin = ends[at] - n[at]
                stop = min(int(np.searchsorted(ends, begin + FILE_IDS - held)) + 1, len(n))
                names.append(batch.column("doc_id").slice(at, stop - at))
                parts.append(ids[begin:ends[stop - 1]])
                lengths.append(n[at:stop])
                held += len(parts[-1])
                at = stop
                if held >= FILE_IDS:
                    yield file()
                    number, names, parts, lengths, held = number + 1, [], [], [], 0
        if parts:
            yield file()

    return staged(ordered.select("doc_id", "text").mapInArrow(
        run, f"part int, number int, doc_ids array<{kind}>, n_ids long, file binary"), "bitplanes")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    kind = dict(files.dtypes)["doc_ids"][len("array<"):-1]
    counts = files.select("part", "number", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("_all"))
    # one row a partition, then one a file: far fewer than documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        F.col("part").alias("_p"), F.col("number").alias("_n"), (F.col("_part_start") + F.col("_in")).alias("_start"))

    def run(batches):
        for batch in released(batches):
            for part, number, names, data in zip(batch["part"], batch["number"], batch["doc_ids"], batch["file"]):
                lengths, ids = decode_file(data)
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": names, "part": part, "number": number, "at": begins, "n_tokens": lengths.astype(np.int64),
                    "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]})

    read = files.select("part", "number", "doc_ids", "file").mapInPandas(
        run, f"doc_id {kind}, part int, number int, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_n"))).select(
        "doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
