"""Multinomial logistic regression by Newton steps, also on the distillation objective (K2, K4).

The objective of one row with scores z = W (x, 1):

    alpha * CE(y, softmax(z)) + (1 - alpha) * c * KL(q, softmax(z / T)),    c = T^2 or 1

that is, the hard loss of the student and, with both sides softened, the divergence from the
teacher's soft labels q (K5 or K6).  ``alpha`` = 1 is the plain classifier.  It is convex in W.

Each step is one pass over the rows: the loss, the k (d + 1) sums of the gradient and the
sums of the Hessian, products of an Arrow batch's columns that each task adds up and Spark
sums by position (hundreds of built-in aggregates in one plan took some 50 us a row).  The
driver solves the resulting system of k (d + 1) numbers, so nothing that grows with the rows
leaves the executors.  Starting from 0 with a fixed rule, the fit is a plain function of the table.

``solver='newton'`` takes the exact Hessian: k (k + 1) / 2 * (d + 1) (d + 2) / 2 sums a step,
few steps.  ``solver='bound'`` is for wide tables: the curvature of every row is at most
that of (I - 11'/k) / 2, so one pass over the second moments gives a matrix for all steps,
which then cost k (d + 1) sums each, in more steps; the loss falls at every one.

A step that raises the loss is halved.  Rows with a null label, feature or soft label are no
training rows and fail the fit.  A small ``ridge`` makes the system regular where features
are collinear (one-hot columns beside the constant) and bounds the weights of separable data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floe.functions.arrays import argmax, softmax_of, sparse_cross_entropy
from floe.functions.text import c


def _scores(features: list[Column], weights: np.ndarray) -> list[Column]:
    out = []
    for row in weights:
        z = F.lit(float(row[-1]))
        for x, w in zip(features, row[:-1]):
            z = z + x * F.lit(float(w))
        out.append(z)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _objective_sums(weights: np.ndarray, alpha: float, t: float, t2_scale: bool, soft: bool, curved: float,
                    blocks: list[tuple[int, int]], at: tuple[np.ndarray, np.ndarray]):
    """Function of a batch's (x, 1), y and q: sums of the loss, of the gradient and of the Hessian's ``blocks``."""
    scale = (1 - alpha) * (t * t if t2_scale else 1.0)

    def sums(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        z = x @ weights.T
        p, top, own = _softmax(z), z.max(1), np.arange(len(y))
        loss = alpha * (np.log(np.exp(z - top[:, None]).sum(1)) + top - z[own, y])
        residual = alpha * p
        residual[own, y] -= alpha
        if soft:
            s = _softmax(z / t)
            logs = np.log(np.where(q > 0, q, 1.0)) - np.log(np.maximum(s, 1e-300))
            loss = loss + scale * np.where(q > 0, q * logs, q).sum(1)
            residual = residual + scale / t * (s - q)
        out = [np.array([loss.sum()]), (residual.T @ x).ravel()]
        for a, b in blocks:
            v = alpha * p[:, a] * ((a == b) - p[:, b])
            if soft:
                v = v + curved * s[:, a] * ((a == b) - s[:, b])
            out.append((x.T @ (x * v[:, None]))[at])
        return np.concatenate(out)
    return sums


def _summed(rows: DataFrame, batch_sums, features: int, length: int, classes: int = 0) -> tuple[int, int, np.ndarray]:
    """(rows, rows left out, sums of ``batch_sums`` over the others) of a table of the columns x.. [y, q..].

    A row with a null, or a ``y`` that is none of the ``classes``, is left out.  A task holds
    one Arrow batch and sends its ``length`` sums, which Spark adds up by position.
    """
    def run(batches):
        n, bad, total = 0, 0, np.zeros(length)
        for batch in batches:
            cols = batch.columns
            good = np.ones(batch.num_rows, bool)
            for col in cols:
                if col.null_count:
                    good &= col.is_valid().to_numpy(zero_copy_only=False)
            values = [col.to_numpy(zero_copy_only=False) for col in cols]
            if classes:
                good &= (values[features] >= 0) & (values[features] < classes)
            n, bad = n + len(good), bad + int((~good).sum())
            x = np.ones((int(good.sum()), features + 1))
            for i in range(features):
                x[:, i] = values[i][good]
            args = []
            if classes:
                soft = values[features + 1:]
                args = [values[features][good].astype(np.int64), np.column_stack([v[good] for v in soft]) if soft else None]
            with np.errstate(all="ignore"):
                total += batch_sums(x, *args)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(length + 2), pa.int32()), pa.array(np.concatenate([[n, bad], total]), pa.float64())], ["at", "v"])

    found = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(length + 2)
    for r in found:
        out[r["at"]] = r["v"]
    return int(out[0]), int(out[1]), out[2:]


@dataclass
class SoftmaxModel:
    """Weights (classes x features and constant) and the loss before every step of the fit."""
    features: list[str]
    weights: np.ndarray
    history: list[float] = field(default_factory=list)
    validation: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, prob_col: str = "probability") -> DataFrame:
        """K3: batch scoring -> probability array column."""
        scored = df.select("*", *[z.alias(f"_floe_z{i}") for i, z in enumerate(
            _scores([c(f).cast("double") for f in self.features], self.weights))])
        names = [f"_floe_z{i}" for i in range(len(self.weights))]
        return scored.withColumn(prob_col, softmax_of([F.col(n) for n in names])).drop(*names)


@dataclass
class SoftmaxRegression:
    features: list[str]
    label_col: str = "y"
    soft_col: str | None = None
    alpha: float = 1.0
    temperature: float = 10.0
    t2_scale: bool = True
    ridge: float = 1e-6
    solver: str = "newton"
    max_steps: int = 30
    tolerance: float = 1e-9
    patience: int = 5
    min_delta: float = 1e-4

    def fit(self, df: DataFrame, num_classes: int | None = None, validation: DataFrame | None = None) -> SoftmaxModel:
        """Fit on ``df``.  With ``validation`` (same columns) the fit stops early by its hard loss
        (K16: ``patience`` steps without a gain of ``min_delta``) and keeps the best step's weights."""
        if self.solver not in ("newton", "bound"):
            raise ValueError("solver must be 'newton' or 'bound'")
        if self.soft_col is None and self.alpha != 1:
            raise ValueError("alpha below 1 needs soft labels")
        rows, k = self._rows(df, num_classes)
        width = len(self.features) + 1
        weights = before = np.zeros((k, width))
        model = SoftmaxModel(list(self.features), weights)
        fixed = self._bound(rows, k) if self.solver == "bound" else None
        best, waited = None, 0
        for _ in range(self.max_steps):
            loss, gradient, curvature = self._pass(rows, weights, fixed)
            loss += 0.5 * self.ridge * float((weights ** 2).sum())
            if model.history and loss > model.history[-1] + 1e-12 * abs(loss):
                weights = (weights + before) / 2
                continue
            # a rise within rounding is none
            model.history.append(min([loss, *model.history[-1:]]))
            model.weights = weights
            if validation is not None:
                held = self._hard_loss(validation, model)
                model.validation.append(held)
                if best is None or held + self.min_delta < best[0]:
                    best, waited = (held, weights), 0
                else:
                    waited += 1
                    if waited >= self.patience:
                        break
            gradient = gradient + self.ridge * weights.ravel()
            if np.abs(gradient).max() < self.tolerance:
                break
            step = np.linalg.solve(curvature + self.ridge * np.eye(len(gradient)), gradient)
            before, weights = weights, weights - step.reshape(k, width)
        if best is not None:
            model.weights = best[1]
        return model

    # -- rows and passes -------------------------------------------------------

    def _rows(self, df: DataFrame, num_classes: int | None) -> tuple[DataFrame, int]:
        """(x0.., y[, q0..]) as plain double columns, and the number of classes."""
        label = c(self.label_col).cast("int")
        if num_classes is None:
            top = df.agg(F.max(label), *([F.max(F.size(c(self.soft_col)))] if self.soft_col else [])).first()
            if top[0] is None:
                raise ValueError("no labelled rows to fit on")
            num_classes = max([int(top[0]) + 1, *[int(t) for t in top[1:] if t is not None]])
        soft = [] if self.soft_col is None else [
            F.get(c(self.soft_col), i).cast("double").alias(f"q{i}") for i in range(num_classes)]
        return df.select(*[c(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)],
                         label.alias("y"), *soft), num_classes

    def _weight_of_soft(self) -> float:
        """Factor of the softened terms' curvature: (1 - alpha) c / T^2."""
        return (1 - self.alpha) * (1.0 if self.t2_scale else 1.0 / self.temperature ** 2)

    def _bound(self, rows: DataFrame, k: int) -> np.ndarray:
        width = len(self.features) + 1
        xs = [f"x{i}" for i in range(width - 1)]
        at = np.triu_indices(width)
        n, _, sums = _summed(rows.select(*xs), lambda x: (x.T @ x)[at], width - 1, len(at[0]))
        moments = np.zeros((width, width))
        moments[at] = sums / max(n, 1)
        moments.T[at] = moments[at]
        return 0.5 * (self.alpha + self._weight_of_soft()) * np.kron(np.eye(k) - 1.0 / k, moments)

    def _pass(self, rows: DataFrame, weights: np.ndarray, fixed: np.ndarray | None):
        """Mean loss, gradient and Hessian (or ``fixed``) at ``weights`` in one pass."""
        k, width = weights.shape
        soft = self.soft_col is not None and self.alpha != 1
        names = [*[f"x{i}" for i in range(width - 1)], "y", *([f"q{a}" for a in range(k)] if soft else [])]
        blocks = [(a, b) for a in range(k) for b in range(a, k)] if fixed is None else []
        at = np.triu_indices(width)
        batch_sums = _objective_sums(weights, self.alpha, float(self.temperature), self.t2_scale, soft,
                                     self._weight_of_soft(), blocks, at)
        n, bad, sums = _summed(rows.select(*names), batch_sums, width - 1, 1 + k * width + len(blocks) * len(at[0]), k)
        if not n:
            raise ValueError("no rows to fit on")
        if bad:
            raise ValueError(f"{bad} rows have a null label, feature or soft label, or a label out of range")
        means = sums / n
        loss, gradient = float(means[0]), means[1:1 + k * width]
        if fixed is not None:
            return loss, gradient, fixed
        curvature = np.zeros((k, width, k, width))
        for (a, b), values in zip(blocks, means[1 + k * width:].reshape(len(blocks), -1)):
            block = np.zeros((width, width))
            block[at] = values
            block.T[at] = values
            curvature[a, :, b, :] = curvature[b, :, a, :] = block
        return loss, gradient, curvature.reshape(k * width, k * width)

    def _hard_loss(self, df: DataFrame, model: SoftmaxModel) -> float:
        scored = model.transform(df, "_floe_p")
        return float(scored.agg(F.avg(sparse_cross_entropy(F.col("_floe_p"), c(self.label_col)))).first()[0])


def predictions(model: SoftmaxModel, df: DataFrame, key: str = "row_id", label: str = "y") -> DataFrame:
    """(key, y, pred, p_pred): predicted class and its probability for every row."""
    scored = model.transform(df, "_floe_p")
    return scored.select(c(key), c(label), argmax(F.col("_floe_p")).alias("pred"),
                         F.array_max("_floe_p").alias("p_pred"))
