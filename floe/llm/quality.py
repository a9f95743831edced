"""Quality classifier: a factorisation machine.

Inputs of a document are hashed words (lower-cased, L2-normalised counts),
statistics of its structure and optional numeric metadata columns.  The score
is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

whose last term covers all pairwise interactions in time linear in the number
of inputs.  The model is fitted in numpy on a bounded sample of labelled rows
(``max_rows``); scoring is one narrow pass over all documents, so only the
model (buckets x (factors + 1) floats, a fixed size) travels to the tasks.

Defined results: a null text counts as empty; an empty text is scored by its
statistics; null metadata count as the training mean; without any usable label
every score is 0.5; without documents the result is empty.  Repeated rows are
scored alike, one row each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.llm.common import give_back, labelled_sample, remainder, word_numbers, worker_table

BUCKETS = 1 << 16
FACTORS = 8
MAX_TRAIN_ROWS = 5_000
N_STATS = 16


def word_buckets(words: list[bytes], table: dict) -> np.ndarray:
    return word_numbers(words, table, np.int64, lambda fresh: [zlib.crc32(w) & (BUCKETS - 1) for w in fresh])


def features(text: str | None, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids, their weights, statistics) of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    n, size = len(words), len(raw)
    stats = np.zeros(N_STATS)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0), stats
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = at[65:91].sum() + at[97:123].sum() + at[128:].sum()
    symbols = at[33:48].sum() + at[58:65].sum() + at[91:97].sum() + at[123:127].sum()
    stats[:10] = (np.log1p(size), at[65:91].sum() / max(letters, 1), at[48:58].sum() / size,
                  symbols / size, (at[46] + at[44]) / size, at[33] / size, at[124] / size,
                  at[10] / size, letters / size, (at[35] + at[36] + at[37] + at[38] + at[42]) / size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), stats
    seq = word_buckets(words, cache)
    ids, counts = np.unique(seq, return_counts=True)
    lines = raw.split(b"\n")
    pairs = np.unique(seq[:-1] * BUCKETS + seq[1:])
    stats[10:] = (size / n, len(ids) / n, counts.max() / n, (seq[1:] == seq[:-1]).mean() if n > 1 else 0.0,
                  len(pairs) / max(n - 1, 1), 1 - len(set(lines)) / len(lines))
    weights = counts / np.sqrt((counts * counts).sum())
    return ids, weights, stats


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray       # buckets + statistics
    factors: np.ndarray      # the same rows x FACTORS
    mean: np.ndarray
    scale: np.ndarray
    fallback: bool = False

    def dense(self, stats: np.ndarray) -> np.ndarray:
        stats = np.where(np.isfinite(stats), stats, self.mean)
        return np.clip((stats - self.mean) / self.scale, -5, 5) / 4

    def logit(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[ids] * x[:, None]
        total = v.sum(0)
        return float(self.bias + self.linear[ids] @ x + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None, metadata: list, cache: dict) -> float:
        if self.fallback:
            return 0.5
        ids, weights, stats = features(text, cache)
        dense = self.dense(np.concatenate([stats, metadata]))
        ids = np.concatenate([ids, BUCKETS + np.arange(len(dense))])
        z = self.logit(ids, np.concatenate([weights, dense]))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_machine(rows: list[tuple], epochs: int = 6, rate: float = 0.1, batch: int = 64,
                l2: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the logistic loss over rows (label, text, *metadata)."""
    n_meta = len(rows[0]) - 2 if rows else 0
    width = BUCKETS + N_STATS + n_meta
    if not rows:
        return FactorisationMachine(0.0, np.zeros(width), np.zeros((width, FACTORS)),
                                    np.zeros(N_STATS + n_meta), np.ones(N_STATS + n_meta), True)
    rng = np.random.default_rng(seed)
    cache: dict = {}
    parts = [features(r[1], cache) for r in rows]
    stats = np.array([np.concatenate([p[2], metadata_values(r[2:])]) for p, r in zip(parts, rows)])
    known = np.where(np.isfinite(stats), stats, np.nan)
    filled = np.where(np.isnan(known).all(0), 0.0, known)
    mean, scale = np.nanmean(filled, 0), np.nanstd(filled, 0)
    m = FactorisationMachine(0.0, np.zeros(width), rng.normal(0, 0.05, (width, FACTORS)),
                             mean, np.where(scale > 1e-9, scale, 1.0))
    y = np.array([r[0] for r in rows], float)
    dense_ids = BUCKETS + np.arange(stats.shape[1])
    ids = [np.concatenate([p[0], dense_ids]) for p in parts]
    xs = [np.concatenate([p[1], m.dense(s)]) for p, s in zip(parts, stats)]
    g_bias, g_lin, g_fac = 1e-6, np.full(width, 1e-6), np.full((width, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            lengths = np.array([len(ids[i]) for i in chosen])
            flat, x = np.concatenate([ids[i] for i in chosen]), np.concatenate([xs[i] for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rows_of = np.repeat(np.arange(len(chosen)), lengths)
            vx = m.factors[flat] * x[:, None]
            total = np.add.reduceat(vx, starts, 0)
            z = (m.bias + np.add.reduceat(m.linear[flat] * x, starts)
                 + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts)))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[chosen]) / len(chosen)
            ex = err[rows_of] * x
            used, inverse = np.unique(flat, return_inverse=True)
            d_lin = np.bincount(inverse, ex, len(used)) + l2 * m.linear[used]
            gv = ex[:, None] * (total[rows_of] - vx)
            d_fac = np.stack([np.bincount(inverse, gv[:, f], len(used)) for f in range(FACTORS)], 1)
            d_fac += l2 * m.factors[used]
            d_bias = err.sum()
            g_bias += d_bias ** 2
            g_lin[used] += d_lin ** 2
            g_fac[used] += d_fac ** 2
            m.bias -= rate * d_bias / np.sqrt(g_bias)
            m.linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
            m.factors[used] -= rate * d_fac / np.sqrt(g_fac[used])
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def metadata_values(values) -> list[float]:
    return [np.nan if v is None else float(np.log1p(max(float(v), 0.0))) for v in values]


def _scorer(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...], modulus: int, held: int, max_rows: int):
    model = docs.sparkSession.sparkContext.broadcast(fit_machine(
        labelled_sample(docs, labels, "quality", modulus, held, max_rows, ["text", *metadata])))

    def scores(text: pd.Series, extra: list[pd.Series]) -> np.ndarray:
        m, cache = model.value, worker_table("quality")
        values = zip(*[e.tolist() for e in extra]) if extra else iter(lambda: (), None)
        made = np.array([m.score(t, metadata_values(None if v is None or v != v else v for v in e), cache)
                         for t, e in zip(text, values)], float)
        give_back()
        return made

    return scores


def score_quality(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (),
                  modulus: int = 4, held: int = 2, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs``."""
    scores = _scorer(docs, labels, metadata, modulus, held, max_rows)

    def run(batches):
        for part in batches:
            extra = [part[f"_m{i}"] for i in range(len(metadata))]
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"],
                                "score": scores(part["text"], extra)})

    rows = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"),
                       "text", *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)])
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float, metadata: tuple[str, ...] = (),
              modulus: int = 4, held: int = 2, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns and no shuffle."""
    scores = _scorer(docs, labels, metadata, modulus, held, max_rows)
    given = [F.col(c).cast("double") for c in metadata]

    @F.pandas_udf("double")
    def score(text: pd.Series, *extra: pd.Series) -> pd.Series:
        return pd.Series(scores(text, list(extra)))

    return docs.filter(score(F.col("text"), *given) >= least)
