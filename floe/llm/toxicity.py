"""Toxicity classifier: subword bags averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (3 to 5
bytes of ``<word>``) and of the whole word, all hashed into one table, so a
misspelling that was never seen shares most of its vectors with the known
spelling.  Words are averaged over windows of ``WINDOW`` words that overlap by
half; the two-class softmax of a window is linear in that average, and a
document gets the score of its most toxic window, so a few toxic words in a
very long text still count.  Subword table and output vector are fitted jointly
in numpy on a bounded sample of labelled rows (``max_rows``).

Because the output is linear in the average, scoring needs one number a word;
each Python worker keeps them for the words it has met.

Defined results: a null or empty text has one empty window and gets the score
of the bias; without any usable label every score is 0.5; without documents
the result is empty.  Repeated rows are scored alike, one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.llm.common import labelled_sample, released, remainder, word_numbers, worker_table

BUCKETS = 1 << 18
DIM = 12
WINDOW = 4
MAX_TRAIN_ROWS = 5_000
NGRAMS = (3, 4, 5)
MIN_DOCS = 5
SHRINK = 20


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, index of the word each belongs to), for all n-grams and whole words."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    prime = np.uint64(1099511628211)
    ids, owners = [], []
    rolling = np.full(len(flat), 14695981039346656037, np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        rolling = (rolling[:m] ^ flat[n - 1:]) * prime
        if n in NGRAMS:
            inside = of[:m] == of[n - 1:]
            mixed = rolling[inside]
            mixed ^= mixed >> np.uint64(29)
            ids.append((mixed % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(of[:m][inside])
    whole = np.array([hash_bytes(w) for w in words], np.int32)
    ids.append(whole)
    owners.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(ids), np.concatenate(owners)


def hash_bytes(word: bytes) -> int:
    import zlib
    return (zlib.crc32(word) * 2654435761 >> 7) % BUCKETS


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of a text of ``n`` words; the last one reaches its end."""
    starts = np.arange(0, max(n - WINDOW, 0) + 1, WINDOW // 2)
    if n > WINDOW and starts[-1] + WINDOW < n:
        starts = np.append(starts, n - WINDOW)
    return starts, np.minimum(starts + WINDOW, n)


@dataclass
class SubwordModel:
    weights: np.ndarray      # one number a bucket: subword vector times output vector
    bias: float
    fallback: bool = False

    def word_scores(self, words: list[bytes], table: dict) -> np.ndarray:
        def learn(fresh: list[bytes]) -> list[float]:
            ids, of = subwords(fresh)
            return (np.bincount(of, self.weights[ids], len(fresh)) / np.bincount(of, minlength=len(fresh))).tolist()
        return word_numbers(words, table, float, learn)

    def score(self, text: str | None, cache: dict) -> float:
        if self.fallback:
            return 0.5
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            logits = np.zeros(1)
        else:
            total = np.concatenate([[0.0], np.cumsum(self.word_scores(words, cache))])
            starts, ends = windows(len(words))
            logits = (total[ends] - total[starts]) / (ends - starts)
        z = logits.max() + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_subwords(rows: list[tuple], steps: int = 40, rate: float = 0.1, seed: int = 11) -> SubwordModel:
    """Adam on the logistic loss over all rows (label, text) at once.

    A bucket takes part if its words occur in ``MIN_DOCS`` documents or more;
    its vector starts along the output vector at the smoothed log odds of its
    words' document counts.
    """
    if not rows:
        return SubwordModel(np.zeros(BUCKETS), 0.0, True)
    rng, rows = np.random.default_rng(seed), list(rows)
    y = np.array([r[0] for r in rows], float)
    vocab: dict[bytes, int] = {}
    docs = []
    while rows:                    # texts are let go as they are read, for the driver's memory
        words = (rows.pop(0)[1] or "").encode("utf-8", "replace").lower().split()
        docs.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
    share = np.clip(y.mean(), 0.01, 0.99)
    prior = float(np.log(share / (1 - share)))
    if not vocab:
        return SubwordModel(np.zeros(BUCKETS), prior)
    names = list(vocab)
    # bucket ids word after word, made in slices of the vocabulary
    found, per_word = [], []
    for at in range(0, len(names), 50_000):
        part = names[at:at + 50_000]
        ids, of = subwords(part)
        found.append(ids[np.argsort(of, kind="stable")])
        per_word.append(np.bincount(of, minlength=len(part)))
    sub_ids, per_word = np.concatenate(found).astype(np.int64), np.concatenate(per_word)
    first_sub = np.concatenate([[0], np.cumsum(per_word)[:-1]])
    del found
    counts = []
    for label in (0, 1):
        seen = [np.unique(d) for d, t in zip(docs, y) if t == label] or [np.zeros(0, np.int32)]
        df = np.bincount(np.concatenate(seen), minlength=len(names))
        counts.append(np.bincount(sub_ids, np.repeat(df, per_word), BUCKETS))
    active = counts[0] + counts[1] >= MIN_DOCS
    odds = np.log((counts[1] + 1) / (y.sum() + 2)) - np.log((counts[0] + 1) / (len(y) - y.sum() + 2))
    odds -= np.median(odds[active]) if active.any() else 0.0
    odds *= (counts[0] + counts[1]) / (counts[0] + counts[1] + SHRINK)
    del vocab, names
    out = rng.normal(0, 0.5, DIM).astype(np.float32)
    table = (2 * odds[:, None] * out / (out @ out) + rng.normal(0, 0.01, (BUCKETS, DIM))) * active[:, None]
    table = table.astype(np.float32)
    flat = np.concatenate(docs)
    spans = [windows(len(d)) for d in docs]
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
    s = np.concatenate([a + o for (a, _), o in zip(spans, base)])
    e = np.concatenate([a + o for (_, a), o in zip(spans, base)])
    width = np.maximum(e - s, 1)
    first = np.concatenate([[0], np.cumsum([len(a) for a, _ in spans])[:-1]])
    bias, moments = -2.0, [[np.zeros_like(x), np.zeros_like(x)] for x in (table, out, np.zeros(1))]

    def step(x, grad, m, t):
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad * grad
        return x - rate * (m[0] / (1 - 0.9 ** t)) / (np.sqrt(m[1] / (1 - 0.99 ** t)) + 1e-8)

    for t in range(1, steps + 1):
        by_bucket = (table @ out).astype(np.float64)
        word = np.add.reduceat(by_bucket[sub_ids], first_sub) / per_word
        total = np.concatenate([[0.0], np.cumsum(word[flat])])
        logits = (total[e] - total[s]) / width
        best = np.maximum.reduceat(logits, first)
        at = np.flatnonzero(logits == np.repeat(best, np.diff(np.append(first, len(logits)))))
        at = at[np.searchsorted(at, first)]
        err = (1 / (1 + np.exp(-np.clip(best + bias, -40, 40))) - y)
        err *= np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        edge = np.bincount(s[at], err / width[at], len(flat) + 1) - np.bincount(e[at], err / width[at], len(flat) + 1)
        grad_word = np.bincount(flat, np.cumsum(edge)[:len(flat)], len(per_word)) / per_word
        by_slot = np.bincount(sub_ids, np.repeat(grad_word, per_word), BUCKETS) * active
        by_slot = by_slot.astype(np.float32)
        d_out = by_slot @ table
        table = step(table, by_slot[:, None] * out, moments[0], t)
        out = step(out, d_out, moments[1], t)
        bias = float(step(np.array([bias]), np.array([err.sum()]), moments[2], t)[0])
    return SubwordModel((table @ out).astype(np.float64), bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0,
                   max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs``."""
    spark = docs.sparkSession
    fitted = fit_subwords(labelled_sample(docs, labels, "toxic", modulus, held, max_rows, ["text"]))
    model = spark.sparkContext.broadcast(fitted)
    mark = f"toxicity-{abs(hash((fitted.bias, fitted.weights.tobytes())))}"

    def run(batches):
        m, cache = model.value, worker_table(mark)
        for part in released(batches):
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"],
                                "score": np.array([m.score(t, cache) for t in part["text"]], float)})

    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "text")
            .mapInPandas(run, f"doc_id {kind}, held_out boolean, score double"))
