"""Katz backoff language model.

    P(w | h) = d(c(hw)) c(hw) / c(h)          if hw was seen in training
             = a(h) P(w | h')                 else (h' is h without its first word)

d is the Good-Turing discount for counts up to ``CUTOFF`` (1 above); a(h) gives
exactly the mass that the discounts of h free to the words unseen after h, so
that every distribution sums to one over the known words and one unknown word.

How it runs.  Documents are cut into chunks of about ``CHUNK`` tokens (whole
documents).  A chunk keeps its words as local numbers, and all counting is an
exchange of keys: a chunk sends its sorted distinct keys (64-bit hashes of
n-grams, delta-coded, transposed and compressed) with numbers, dealt by key
range into buckets; a bucket adds up the numbers of each key over all chunks, and
answers each chunk with the sums in its order.  A key is sent once a chunk however
often it occurs, so a hot word or word pair has at most one entry a chunk.

1. per order: n-gram counts.  The sums of a bucket are the count table, partitioned
   by bucket; counts of counts (a few numbers) give the discounts.
2. per order from 2: the sums of c, d c and P(w | h') over the n-grams seen after
   each history; of the chunks holding an n-gram one, its owner, adds it.  They give
   c(h) and a(h).
3. every chunk evaluates its distinct n-grams recursively, lowest order first, and
   adds up its documents' tokens.

The chunks, and everything that a pass returns, are written to the shared folder, where the
next pass reads them; all but the scores is removed at the end.

Defined results: a null or empty text is one end token; words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a word not seen in training is the
unknown word; where discounts can't be formed (n_r = 0) half a count is taken off
counts up to the cutoff; where no mass would be left one count is added to the
total; without training documents every token has probability 1; without documents
there are no rows.  Repeated rows are counted and scored as they come.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floe.llm.common import finished, give_back, released, staged, sweep
from floe.llm.dedup import mix

CHUNK = 2_000_000
BUCKET = 3_000_000         # tokens for each bucket of keys
CUTOFF = 5
END = xxhash.xxh3_64_intdigest(b" end ")       # no word holds a space


def pack(values: np.ndarray) -> bytes:
    """Byte planes of a numeric array, compressed."""
    rows = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(rows.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def lean(values: np.ndarray) -> np.ndarray:
    """Whole numbers as unsigned integers, others as doubles."""
    return values.astype(np.uint64) if values.dtype.kind in "iu" else values.astype(np.float64)


# -- chunks --------------------------------------------------------------------

def _chunks(docs: DataFrame) -> DataFrame:
    """Rows (chunk, doc_ids, flags, lengths, words, vocab)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        base, number = TaskContext.get().partitionId() << 24, 0
        ids: dict[bytes, int] = {b" end ": 0}
        names, flags, seqs, held = [], [], [], 0

        def row():
            vocab = np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)
            order = np.argsort(vocab)
            place = np.empty(len(vocab), np.uint32)
            place[order] = np.arange(len(vocab), dtype=np.uint32)
            return pd.DataFrame({
                "chunk": [base + number], "doc_ids": [names], "flags": [np.packbits(flags).tobytes()],
                "lengths": [pack(np.array([len(s) for s in seqs], np.uint32))],
                "words": [pack(place[np.concatenate(seqs)])], "vocab": [pack_keys(vocab[order])]})

        for batch in released(batches):
            known = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for name, text, held_out in zip(known, batch["text"], batch["held_out"]):
                words = (text or "").encode("utf-8", "replace").lower().split()
                for w in set(words):
                    if w not in ids:
                        ids[w] = len(ids)
                seq = np.zeros(len(words) + 1, np.uint32)
                seq[:-1] = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))
                names.append(name)
                flags.append(bool(held_out))
                seqs.append(seq)
                held += len(seq)
                if held >= CHUNK:
                    yield row()
                    ids, names, flags, seqs, held, number = {b" end ": 0}, [], [], [], 0, number + 1
        if seqs:
            yield row()

    return docs.select("doc_id", "text", "held_out").mapInPandas(
        run, f"chunk long, doc_ids array<{kind}>, flags binary, lengths binary, words binary, vocab binary")


class Chunk:
    """The n-grams of one chunk, order by order."""

    def __init__(self, row):
        self.number, self.doc_ids = int(row.chunk), list(row.doc_ids)
        self.lengths = unpack(row.lengths, np.uint32).astype(np.int64)
        self.held_out = np.unpackbits(np.frombuffer(row.flags, np.uint8), count=len(self.lengths)).astype(bool)
        self.words = unpack(row.words, np.uint32).astype(np.int64)
        self.vocab = unpack_keys(row.vocab)
        self.ends = np.cumsum(self.lengths)
        self.first = self.ends - self.lengths
        self.train = np.repeat(~self.held_out, self.lengths)

    def gram(self, order: int):
        """(sorted distinct keys, index of every token's n-gram, one place of each key, token keys)."""
        if order == 1:
            codes = self.vocab[self.words]
        else:
            history = self.history(order)
            codes = mix(history ^ (self.vocab[self.words] * np.uint64(2 * order + 1)))
        keys, place, index = np.unique(codes, return_index=True, return_inverse=True)
        return keys, index.astype(np.uint32), place.astype(np.uint32), codes

    def history(self, order: int) -> np.ndarray:
        """Key of the ``order`` - 1 tokens before each token; ends stand before a document."""
        if order == 2:
            codes = self.vocab[self.words]
        else:
            codes = self.gram(order - 1)[3]
        out = np.empty_like(codes)
        out[1:] = codes[:-1]
        out[self.first] = padding(order - 1)
        return out

    def counts(self, order: int):
        keys, index, _, _ = self.gram(order)
        return keys, np.bincount(index, self.train, len(keys)).astype(np.uint64)


def padding(order: int) -> np.uint64:
    """Key of ``order`` ends in a row."""
    code = np.array([END], np.uint64)
    for n in range(2, order + 1):
        code = mix(code ^ (np.array([END], np.uint64) * np.uint64(2 * n + 1)))
    return code[0]


# -- exchange of keys ------------------------------------------------------------

def _send(chunk: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> pd.DataFrame:
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.array([i * width for i in range(1, buckets)], np.uint64))
    spans = [(a, b) for a, b in zip([0, *edges], [*edges, len(keys)])]
    rows = [(chunk, i, pack_keys(keys[a:b]), [pack(lean(v[a:b])) for v in values])
            for i, (a, b) in enumerate(spans) if b > a]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "vals"])


SENT = "chunk long, bucket int, keys binary, vals array<binary>"
ANSWER = "chunk long, bucket int, sums array<binary>, owner binary, tally array<long>"


def _add_up(whole: bool):
    dtype = np.uint64 if whole else np.float64

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        parts = [unpack_keys(k) for k in rows["keys"]]
        uniq, first, index = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        owner = np.zeros(len(index), bool)
        owner[first] = True
        totals = []
        for i in range(len(rows["vals"].iloc[0])):
            values = np.concatenate([unpack(v[i], dtype) for v in rows["vals"]])
            totals.append(np.bincount(index, values, len(uniq)))
        if whole:
            totals = [t.astype(np.uint64) for t in totals]
            c = totals[0].astype(np.int64)
            tally = [int((c > 0).sum()), int(c.sum()), *np.bincount(c[c <= CUTOFF + 1], minlength=CUTOFF + 2)[1:].tolist()]
        else:
            tally = [0] * (CUTOFF + 3)
        out, at = [], 0
        for n, (chunk, bucket, part) in enumerate(zip(rows["chunk"], rows["bucket"], parts)):
            span = index[at:at + len(part)]
            out.append((chunk, bucket, [pack(lean(t[span])) for t in totals],
                        np.packbits(owner[at:at + len(part)]).tobytes(), tally if n == 0 else [0] * len(tally)))
            at += len(part)
        return pd.DataFrame(out, columns=["chunk", "bucket", "sums", "owner", "tally"])

    return run


def _read(rows: pd.DataFrame, whole: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Answers of one chunk in the order of its keys: (sums, owner flags)."""
    rows = rows.sort_values("bucket")
    dtype = np.uint64 if whole else np.float64
    sums = [np.concatenate([unpack(s[i], dtype) for s in rows["sums"]]) for i in range(len(rows["sums"].iloc[0]))]
    owner = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(unpack(s[0], dtype))).astype(bool)
                            for o, s in zip(rows["owner"], rows["sums"])])
    return sums, owner


# -- the model -------------------------------------------------------------------

def discounts(n_r: list[int]) -> list[float]:
    """d(r) for r = 0..CUTOFF from n_1..n_(CUTOFF+1): Katz's form of Good-Turing."""
    out = [1.0]
    top = (CUTOFF + 1) * n_r[CUTOFF] / n_r[0] if n_r[0] else 1.0
    for r in range(1, CUTOFF + 1):
        ratio = (r + 1) * n_r[r] / (r * n_r[r - 1]) if n_r[r - 1] else 0.0
        d = (ratio - top) / (1 - top) if top < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    c = counts.astype(np.float64)
    return c * np.where(counts <= CUTOFF, np.array(d)[np.minimum(counts, CUTOFF).astype(np.int64)], 1.0)


class Evaluation:
    """Probabilities of a chunk's distinct n-grams, order by order."""

    def __init__(self, chunk: Chunk, facts: dict[tuple[str, int], pd.DataFrame], model: dict, order: int):
        self.chunk, self.model = chunk, model
        n = model["tokens"]
        keys, index, place, _ = chunk.gram(1)
        (self.count,), _ = _read(facts[("count", 1)], True)
        d, scale, unknown = model["d"][1], model["scale"], model["unknown"]
        self.prob = np.where(self.count > 0, discounted(self.count, d) / max(n, 1) * scale, unknown)
        self.index, self.place = index, place
        for o in range(2, order + 1):
            self.climb(o, facts, o == order)

    def climb(self, o: int, facts, last: bool) -> None:
        lower_index, lower = self.index, self.prob
        _, index, place, _ = self.chunk.gram(o)
        (count,), owner = _read(facts[("count", o)], True)
        below = lower[lower_index[place]]
        h_keys, h_index = np.unique(self.chunk.history(o)[place], return_inverse=True)
        if ("history", o) not in facts:      # the pass that gathers the sums of this order
            mine = owner & (count > 0)
            at = h_index[mine]
            self.sums = (h_keys, [np.bincount(at, v, len(h_keys)) for v in (
                count[mine].astype(float), discounted(count[mine], self.model["d"][o]), below[mine])])
            return
        (total, kept, low), _ = _read(facts[("history", o)], False)
        bare = (total > 0) & (total - kept < 1e-9 * total)       # no discount: one count is added
        denominator = np.where(bare, total + 1, total)
        free = np.where(bare, 1.0, total - kept)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(total > 0, free / denominator / np.maximum(1 - low, 1e-300), 1.0)
            seen = discounted(count, self.model["d"][o]) / denominator[h_index]
        self.prob = np.where(count > 0, seen, alpha[h_index] * below)
        self.index, self.place = index, place


def _facts(rows: pd.DataFrame) -> dict[tuple[str, int], pd.DataFrame]:
    return {key: part for key, part in rows.groupby(["what", "order"])}


def score_documents(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows whose ``held_out`` is false.
    """
    return finished(docs.sparkSession, "scores", lambda: _scored(docs, held_out, order))


def _scored(docs: DataFrame, held_out: Column, order: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    # written first: answers belong to a chunk's keys by their order, so a lost executor must find the same chunks
    chunks = staged(_chunks(docs.select("doc_id", "text", held_out.alias("held_out"))), "chunks")
    # a bucket is one group of rows in memory, so there are as many as the tokens need
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chunks.count() * CHUNK / BUCKET))
    facts, model = None, {"d": {}, "tokens": 0}

    def add(sent: DataFrame, what: str, o: int) -> DataFrame:
        nonlocal facts
        answer = staged(sent.groupBy("bucket").applyInPandas(_add_up(what == "count"), ANSWER), f"{what}{o}")
        new = answer.select("chunk", F.lit(what).alias("what"), F.lit(o).alias("order"), "bucket", "sums", "owner")
        facts = new if facts is None else facts.union(new)
        return answer

    for o in range(1, order + 1):
        answer = add(chunks.mapInPandas(_counting(o, buckets), SENT), "count", o)
        sweep(spark)
        tally = answer.agg(*[F.sum(F.col("tally")[i]) for i in range(CUTOFF + 3)]).first()
        types, tokens, *n_r = [int(x or 0) for x in tally]
        model["d"][o] = discounts(n_r)
        if o == 1:
            freed = sum(r * n * (1 - d) for r, n, d in zip(range(1, CUTOFF + 1), n_r, model["d"][1][1:]))
            model |= {"tokens": tokens, "types": types, "scale": 1.0, "unknown": freed / tokens if tokens else 1.0}
            if tokens and not freed:
                model |= {"scale": tokens / (tokens + 1), "unknown": 1 / (tokens + 1)}
        else:
            sums = _gathering(o, {**model, "d": dict(model["d"])}, buckets)
            add(chunks.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInPandas(sums, SENT), "history", o)
            sweep(spark)
    return chunks.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInPandas(
        _scoring(model, order), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")


def _counting(o: int, buckets: int):
    def run(batches):
        for batch in released(batches):
            for row in batch.itertuples():
                chunk = Chunk(row)
                keys, counts = chunk.counts(o)
                yield _send(chunk.number, keys, [counts], buckets)
                del chunk, keys, counts
                give_back()
    return run


def _gathering(o: int, model: dict, buckets: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(next(left.itertuples()))
        keys, sums = Evaluation(chunk, _facts(right), model, o).sums
        sent = _send(chunk.number, keys, sums, buckets)
        del chunk, keys, sums
        give_back()
        return sent
    return run


def _scoring(m: dict, order: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk, told = Chunk(next(left.itertuples())), _facts(right)
        e = Evaluation(chunk, told, m, order)
        (ones,), _ = _read(told[("count", 1)], True)
        known = ones[chunk.gram(1)[1]].astype(np.float64)
        base = np.log10((known + 0.1) / (m["tokens"] + 0.1 * (m["types"] + 1)))
        logs = np.log10(e.prob)[e.index]
        return pd.DataFrame({
            "doc_id": chunk.doc_ids, "held_out": chunk.held_out, "n_tokens": chunk.lengths,
            "n_known": np.add.reduceat((known > 0).astype(np.int64), chunk.first),
            "train_tokens": m["tokens"], "base_score": np.add.reduceat(base, chunk.first),
            "score": np.add.reduceat(logs, chunk.first)})
    return run
