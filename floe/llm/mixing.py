"""Mixing to target weights by soft domain membership.

1. A softmax classifier on hashed words is fitted in numpy on a bounded sample of
   labelled documents (rows of the labels table that have a domain).
2. One pass gives every document its tokens t_d and posterior p_dk.
3. Nonnegative rates r_d minimise

       1/2 sum_k ((sum_d r_d t_d p_dk - T_k) / T_k)^2 ,   r_d >= 0, nearest to r = 1,

   where T_k is the wanted number of expected tokens of domain k, by projected gradient
   steps on the rates from r = 1:  r_d <- max(r_d - t_d sum_k p_dk y_k / T_k, 0).  The
   step's K numbers y are the residual, preconditioned by the K x K Gram matrix of the
   rows above 0, so that very long documents don't slow it down; several lengths of it,
   and of the plain gradient, are tried in one pass and the best is taken.  A pass is one
   aggregation in which every task adds up its rows' share of the totals and the matrix.
   No rate is stored: a row's rate is its replay of the steps, and a lost executor costs
   one recomputation.  The steps end when every domain is within ``TOLERANCE`` of its
   target, or when a dual bound proves that no rates come closer.

Without given targets the weights are the domains' natural shares to the power
``TEMPERATURE``, at the smallest total that shrinks no domain.

Defined results: a null or empty text has no tokens, the posterior of the bias and
rate 1; targets that no rates reach give the nearest rates, a warning and the
residual (``fit_rates``); a null domain is no label; without labelled documents all belong to one
domain and all rates are 1; a target domain that the sample doesn't know is
refused; without documents the result is empty.  Repeated rows get equal rates.
"""

from __future__ import annotations

import uuid
import warnings
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floe.llm.common import give_back, labelled_sample, released, staged, word_numbers, worker_table

BUCKETS = 1 << 15
MAX_TRAIN_ROWS = 4_000
TEMPERATURE = 0.7
TOLERANCE = 1e-3
TRIALS = 0.25 ** np.arange(8)   # lengths of a preconditioned step that one pass tries
PLAIN = 4.0 ** np.arange(4)     # and of a plain gradient step
MAX_PASSES = 1_000              # raises, never returns, beyond


def _buckets(text: str | None, table: dict) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return word_numbers(words, table, np.int64, lambda fresh: [zlib.crc32(w) & (BUCKETS - 1) for w in fresh])


def fit_domains(rows: list[tuple[str, str | None]], epochs: int = 5, rate: float = 0.5,
                batch: int = 64, seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, weights, bias) of a softmax on mean word weights, from rows (domain, text)."""
    names = sorted({r[0] for r in rows})
    if not names:
        return [""], np.zeros((BUCKETS, 1), np.float32), np.zeros(1)
    rng, cache = np.random.default_rng(seed), {}
    seqs = [_buckets(r[1], cache) for r in rows]
    y = np.eye(len(names))[[names.index(r[0]) for r in rows]]
    w, b = np.zeros((BUCKETS, len(names))), np.log(y.mean(0) + 1e-9)
    g_w, g_b = np.full_like(w, 1e-8), np.full_like(b, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            of = np.repeat(np.arange(len(chosen)), [len(seqs[i]) for i in chosen])
            flat = np.concatenate([seqs[i] for i in chosen])
            share = 1 / np.maximum(np.bincount(of, minlength=len(chosen)), 1)
            used, inv = np.unique(flat, return_inverse=True)
            z = np.stack([np.bincount(of, w[flat, k], len(chosen)) * share for k in range(len(names))], 1) + b
            p = np.exp(z - z.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - y[chosen]) / len(chosen)
            part = (err * share[:, None])[of]
            d_w = np.stack([np.bincount(inv, part[:, k], len(used)) for k in range(len(names))], 1)
            g_w[used] += d_w ** 2
            g_b += err.sum(0) ** 2
            w[used] -= rate * d_w / np.sqrt(g_w[used])
            b -= rate * err.sum(0) / np.sqrt(g_b)
    return names, w.astype(np.float32), b


def _classified(texts, model, cache: dict) -> tuple[list[int], list[np.ndarray]]:
    """Tokens and posterior of each text."""
    (_, w, b), tokens, post = model, [], []
    for text in texts:
        seq = _buckets(text, cache)
        z = b + (w[seq].mean(0) if len(seq) else 0)
        p = np.exp(z - z.max())
        tokens.append(len(seq))
        post.append(p / p.sum())
    return tokens, post


def posteriors(docs: DataFrame, model, extra: list[str]) -> DataFrame:
    """Columns ``extra``, tokens, p (array of doubles) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in released(batches):
            out = part[extra].copy()
            out["tokens"], out["p"] = _classified(part["text"], shared.value, worker_table("mixing"))
            yield out

    kinds = dict(docs.dtypes)
    return docs.select(*extra, "text").mapInPandas(
        run, ", ".join([*(f"`{c}` {kinds[c]}" for c in extra), "tokens long", "p array<double>"]))


def replay(t: np.ndarray, p: np.ndarray, scale: np.ndarray, step: float, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps along ``history``, from 1."""
    r = np.ones(len(t))
    for residual in history:
        np.maximum(r - step * t * (p @ (residual * scale)), 0, out=r)
    return r


def shares(t: np.ndarray, p: np.ndarray, scale: np.ndarray, history: list[np.ndarray], trials: np.ndarray,
           residual: np.ndarray) -> tuple[np.ndarray, float]:
    """What rows add up to after ``history`` and each of ``trials``, and the smallest p . (scale * residual).

    A line is the K scaled totals and the K x K Gram matrix of the rows above 0.
    """
    a, lines, base = t[:, None] * p * scale, [], replay(t, p, scale, 1.0, history)
    for trial in trials:
        r = np.maximum(base - a @ trial, 0)
        above = a[r > 0]
        lines.append(np.concatenate([r @ a, (above.T @ above).ravel()]))
    return np.array(lines), float((p[t > 0] @ (scale * residual)).min(initial=np.inf))


def solve(pass_over: Callable, wanted: np.ndarray, scale: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps, residual of each domain over its target); ``pass_over`` sums ``shares`` over all rows."""
    k, history, first = len(wanted), [], 1.0
    (line,), _ = pass_over(history, np.zeros((1, k)), np.zeros(k))
    for _ in range(MAX_PASSES):
        residual, gram = line[:k] - wanted, line[k:].reshape(k, k)
        if np.abs(residual).max() <= TOLERANCE or not gram.any():
            return history, residual
        unit = 1 / np.sqrt(np.where(gram.diagonal() > 0, gram.diagonal(), np.inf))
        ahead = unit * np.linalg.lstsq(gram * unit[:, None] * unit, unit * residual, rcond=1e-12)[0]
        plain = residual / np.linalg.eigvalsh(gram)[-1]
        trials = np.concatenate([first * TRIALS[:, None] * ahead, PLAIN[:, None] * plain])
        lines, low = pass_over(history, trials, residual)
        # y is a point of the dual of the least squares (y . a_d >= 0 for every row), so it bounds them from below
        y = residual + max(0.0, -low) / scale
        bound = -(y @ y) / 2 - y @ wanted
        size = np.linalg.norm(residual)
        if size - np.sqrt(max(2 * bound, 0.0)) <= TOLERANCE:
            return history, residual
        sizes = np.linalg.norm(lines[:, :k] - wanted, axis=1)
        best = int(np.argmin(sizes))
        if sizes[best] < size * (1 - 1e-12):
            history, line, first = [*history, trials[best]], lines[best], 1.0
        elif first > 1e-9:
            first *= TRIALS[-1] / 4
        else:
            return history, residual        # no step of any length comes closer
    raise RuntimeError(f"rates not found in {MAX_PASSES} passes; residuals {residual.tolist()}")


def fit_rates(rows: DataFrame, targets: np.ndarray | None) -> tuple[dict, np.ndarray]:
    """What ``replay`` needs, and the targets; ``rows`` has (tokens, p) and is read once a step.

    The state also holds the expected tokens that are ``reached`` and the ``residual`` of each
    domain over its target (over all tokens where the target is 0).
    """
    k = len(targets) if targets is not None else rows.select(F.max(F.size("p"))).first()[0] or 1
    sums = [F.sum(F.col("tokens") * F.col("p")[i]) for i in range(k)]
    now = np.array([float(v or 0) for v in rows.agg(*sums).first()])
    if targets is None:
        weight = np.where(now > 0, now, 0) ** TEMPERATURE
        weight = weight / weight.sum() if weight.sum() else np.full(k, 1 / k)
        targets = weight * max((n / w for n, w in zip(now, weight) if w > 0), default=0.0)
    scale = 1 / np.maximum(targets, 1e-9)
    scale = np.where(targets > 0, scale, 1 / max(now.sum(), 1.0))
    width = k + k * k

    def pass_over(history, trials, residual):
        def part_of(batches):
            for part in released(batches):
                t, p = part["tokens"].to_numpy(float), np.stack(part["p"].to_numpy()) if len(part) else np.zeros((0, k))
                lines, low = shares(t, p, scale, history, trials, residual)
                yield pd.DataFrame({"i": np.arange(len(trials)), "v": list(lines), "low": low})

        got = rows.select("tokens", "p").mapInPandas(part_of, "i int, v array<double>, low double").groupBy("i").agg(
            *[F.sum(F.col("v")[j]) for j in range(width)], F.min("low")).collect()
        lines = np.zeros((len(trials), width))
        for i, *line, _ in got:
            lines[i] = line
        return lines, min((row[-1] for row in got), default=np.inf)

    history, residual = solve(pass_over, targets * scale, scale)
    if np.abs(residual).max() > TOLERANCE:
        warnings.warn(f"no rates reach the targets; nearest residuals by domain: {residual.round(4).tolist()}")
    return {"scale": scale, "step": 1.0, "history": history, "residual": residual,
            "reached": targets + residual / scale}, targets


def fit_mixture(docs: DataFrame, labels: DataFrame, domain: str = "lang",
                weights: dict[str, float] | None = None, total: float | None = None,
                max_rows: int = MAX_TRAIN_ROWS) -> tuple[tuple, dict, DataFrame]:
    """(classifier, what ``replay`` needs, posteriors of every row with doc_id and h).

    ``weights`` by domain with ``total`` expected tokens (default: as many as now)
    replace the tempered natural shares; h is a hash of the text.
    """
    marks = labels.select("doc_id").withColumn("_known", F.lit(1))
    rows = labelled_sample(docs, marks, "_known", 1, -1, max_rows, [domain, "text"])
    model = fit_domains([(r[1], r[2]) for r in rows if r[1] is not None])
    names = model[0]
    table = staged(posteriors(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), model, ["doc_id", "h"]),
                   "posteriors")
    targets = None
    if weights is not None:
        if strange := sorted(set(weights) - set(names)):
            raise ValueError(f"target domains without labelled documents: {strange}")
        wanted = np.array([weights.get(n, 0.0) for n in names])
        now = total if total is not None else float(table.agg(F.sum("tokens")).first()[0] or 0)
        targets = wanted / wanted.sum() * now
    return model, fit_rates(table, targets)[0], table


def document_rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, h, tokens, domain, p, rate) for every row; ``options`` as in ``fit_mixture``."""
    model, state, table = fit_mixture(docs, labels, **options)
    names = model[0]

    def rate(batches):
        for part in released(batches):
            p = np.stack(part["p"].to_numpy()) if len(part) else np.zeros((0, len(names)))
            out = part.copy()
            out["rate"] = replay(part["tokens"].to_numpy(float), p, state["scale"], state["step"], state["history"])
            out["domain"] = [names[i] for i in p.argmax(1)]
            yield out[["doc_id", "h", "tokens", "domain", "p", "rate"]]

    kind = dict(docs.dtypes)["doc_id"]
    return table.mapInPandas(rate, f"doc_id {kind}, h long, tokens long, domain string, p array<double>, rate double")


def copies_of(rate: Column, *key: Column) -> Column:
    """floor(rate + u) with u in [0, 1) from a hash of ``key``: rate copies on average."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + u).cast("int")


def mix_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated by its rate; the columns of ``docs``.

    The rate of a row follows from its own text and the fitted numbers, so it is
    worked out where the row is: the documents are read once more, not shuffled.
    """
    model, state, _ = fit_mixture(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=float)
        tokens, post = _classified(text, shared.value, worker_table("mixing"))
        give_back()
        return pd.Series(replay(np.array(tokens, float), np.stack(post), state["scale"], state["step"],
                                state["history"]))

    # marked as not deterministic, so that the optimiser doesn't repeat it in a filter of its own
    copies = copies_of(rate.asNondeterministic()(docs["text"]), F.lit("mix"), docs["doc_id"],
                       F.xxhash64(docs["text"]))
    number, each = f"copies_{uuid.uuid4().hex}", f"copy_{uuid.uuid4().hex}"
    counted = docs.select(*[docs[c] for c in docs.columns], copies.alias(number))
    return counted.withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(number)))).drop(number, each)
