"""Expressions over probability / feature arrays.

All are built from Spark higher-order functions (``transform``,
``aggregate``, ``zip_with``), so they run inside generated code on the
executors; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping constants of the Keras losses and the attention map.
EPSILON = 1e-7
ATTENTION_EPS = 1e-8


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Inside a lambda, any expression that is not a lambda variable is
    re-evaluated for every element; binding it first keeps array operators
    linear in the array length.  (A one-element ``aggregate`` whose
    accumulator is the value.)
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _x: acc, body)


def matrix_literal(rows: list[list[float]]) -> Column:
    """The numbers of ``rows`` one after another, as an array<double> that the optimiser folds into one literal.

    An array of single literals would be a plan node for each number.
    """
    return F.split(F.lit(",".join(repr(float(x)).replace("inf", "Infinity").replace("nan", "NaN")
                                  for row in rows for x in row)), ",").cast("array<double>")


def explode_positions(df, keep: list, arr: Column, pos: str, value: str):
    """Rows (keep..., pos, value) for every element, like ``posexplode``.

    ``posexplode`` makes Catalyst infer a ``size(arr) > 0`` filter that
    evaluates a computed array a second time (even inside the scan's data
    filters); the outer form plus a filter on its output yields the same rows
    with one evaluation.
    """
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, value))
            .where(F.col(pos).isNotNull()))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


# Every output of the scalar form repeats all inputs, so it is used only for
# narrow, flat inputs; wider or nested ones use the let-bound lambda form.
SCALAR_SOFTMAX_MAX = 10


def softmax_of(values: list[Column]) -> Column:
    """Softmax of a fixed list of scalar columns, as plain (codegen) expressions.

    Used when the width is known when the plan is built (number of classes,
    fixture widths); avoids interpreted lambdas entirely.
    """
    if len(values) > SCALAR_SOFTMAX_MAX:
        return softmax(F.array(*values))
    vals = [v.cast("double") for v in values]
    m = F.greatest(*vals) if len(vals) > 1 else vals[0]
    exps = [F.exp(v - m) for v in vals]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return F.array(*[e / total for e in exps])


def _elements(arr: Column, width: int) -> list[Column]:
    return [F.element_at(arr, i + 1).cast("double") for i in range(width)]


def softmax(arr: Column, width: int | None = None) -> Column:
    """Max-subtracted softmax of a numeric array (each input evaluated once).

    With ``width`` (known array length) it compiles to scalar expressions.
    """
    if width:
        return softmax_of(_elements(arr, width))

    def with_values(a):
        return F.aggregate(a, F.lit(float("-inf")), lambda m, x: F.greatest(m, x), lambda m: F.aggregate(
            a, F.lit(0.0).cast("double"), lambda t, x: t + F.exp(x - m),
            lambda t: F.transform(a, lambda x: F.exp(x - m) / t)))
    return let(arr.cast("array<double>"), with_values)


def temperature_softmax(arr: Column, temperature: float = 10.0, width: int | None = None) -> Column:
    """K5: softmax(p / T) of the (probability) array."""
    t = float(temperature)
    if width:
        return softmax_of([x / F.lit(t) for x in _elements(arr, width)])
    return softmax(F.transform(arr.cast("array<double>"), lambda x: x / F.lit(t)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def log_temperature_softmax(arr: Column, temperature: float = 10.0, width: int | None = None) -> Column:
    """K6: softmax(log(clip(p, 1e-7, 1)) / T)."""
    t = float(temperature)
    if width:
        return softmax_of([F.ln(clip(x, EPSILON, 1.0)) / F.lit(t) for x in _elements(arr, width)])
    return softmax(F.transform(arr.cast("array<double>"),
                               lambda x: F.ln(clip(x, EPSILON, 1.0)) / F.lit(t)))


def sparse_cross_entropy(probs: Column, label: Column) -> Column:
    """K7 per row: -log(clip(p[y], eps, 1-eps)); label is a 0-based code."""
    p = F.element_at(probs, label.cast("int") + 1)
    return -F.ln(clip(p, EPSILON, 1.0 - EPSILON))


def kl_divergence(target: Column, pred: Column, width: int | None = None) -> Column:
    """K8 per row: sum t*log(t/s), both clipped to [eps, 1] as in Keras."""
    if width:
        total = None
        for t, s_ in zip(_elements(target, width), _elements(pred, width)):
            ct, cs = clip(t, EPSILON, 1.0), clip(s_, EPSILON, 1.0)
            term = ct * F.ln(ct / cs)
            total = term if total is None else total + term
        return total
    terms = F.zip_with(target, pred, lambda t, s: clip(t, EPSILON, 1.0)
                       * F.ln(clip(t, EPSILON, 1.0) / clip(s, EPSILON, 1.0)))
    return array_sum(terms)


def blend(hard: Column, soft: Column, alpha: float, att: Column | None = None,
          beta: float = 0.0) -> Column:
    """alpha*hard + (1-alpha)*soft (+ beta*att)."""
    total = F.lit(float(alpha)) * hard + F.lit(1.0 - float(alpha)) * soft
    if att is not None:
        total = total + F.lit(float(beta)) * att
    return total


def attention_map(feature_map: Column) -> Column:
    """Per position sum of squares over channels, normalized over positions."""
    energy = F.transform(feature_map, lambda row: F.aggregate(
        row, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    return let(energy, lambda en: F.aggregate(
        en, F.lit(0.0).cast("double"), lambda t, a: t + a,
        lambda t: F.transform(en, lambda a: a / (t + F.lit(ATTENTION_EPS)))))


def mean_squared_error(a: Column, b: Column) -> Column:
    """K12 per row: mean over positions of (a-b)^2."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return array_sum(sq) / F.size(sq)


def resample_linear(arr: Column, length: int) -> Column:
    """Linear resize of a 1-d map to ``length`` with half-pixel centres.

    Output position i samples the input at (i + 0.5) * n / length - 0.5,
    interpolating between the clamped floor and ceil neighbours.
    """
    out = F.sequence(F.lit(0), F.lit(int(length) - 1))

    def resample(a):
        n = F.size(a)

        def sample(i):
            src = (i + F.lit(0.5)) * n / F.lit(float(length)) - F.lit(0.5)
            base = F.floor(src)
            lo = F.greatest(base, F.lit(0)).cast("int")
            hi = F.least(F.ceil(src), n - 1).cast("int")
            w = src - base
            x_lo = F.element_at(a, lo + 1)
            x_hi = F.element_at(a, hi + 1)
            return x_lo + (x_hi - x_lo) * w

        return F.transform(out, sample)

    return let(arr.cast("array<double>"), resample)


def argmax(arr: Column) -> Column:
    """0-based index of the largest value, first index on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def polynomial_sparsity(step: Column, initial: float = 0.0, final: float = 0.5,
                        begin: int = 0, end: int = 1000, power: int = 3) -> Column:
    """Sparsity target at ``step`` of a polynomial decay schedule."""
    progress = (step - F.lit(begin)).cast("double") / F.lit(float(end - begin))
    p = clip(progress, 0.0, 1.0)
    return F.lit(final) + F.lit(initial - final) * F.pow(F.lit(1.0) - p, F.lit(float(power)))


def prune_step(step: Column, begin: int = 0, end: int = 1000, frequency: int = 100) -> Column:
    """Whether masks are updated at ``step``."""
    return ((step >= begin) & (step <= end) & (((step - begin) % frequency) == 0))


def magnitude_prune(w: Column, sparsity: float = 0.5, ties: str = "keep") -> Column:
    """Zero the smallest-magnitude share of a weight array.

    Keeps k = round(n * (1 - sparsity)) weights by magnitude (round half to
    even).  ``ties='keep'`` (the pruning library's rule): every weight whose
    |w| reaches the k-th largest magnitude survives, so ties at the
    threshold may keep more than k.  ``ties='position'``: exactly k survive,
    ties broken by the earlier position.
    """
    k = F.bround(F.size(w) * F.lit(1.0 - float(sparsity)), 0).cast("int")
    if ties == "position":
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))
        kept = F.transform(F.slice(ranked, 1, F.greatest(k, F.lit(0))), lambda r: r["i"])
        return let(kept, lambda keep: F.transform(
            w, lambda x, i: F.when(F.array_contains(keep, i), x).otherwise(F.lit(0.0))))
    mags = F.sort_array(F.transform(w, lambda x: F.abs(x)), asc=False)
    threshold = F.when(k > 0, F.element_at(mags, F.greatest(k, F.lit(1)))).cast("double")

    def keep(thr):
        return F.transform(w, lambda x: F.when(thr.isNotNull() & (F.abs(x) >= thr), x).otherwise(F.lit(0.0)))

    return F.aggregate(F.array(F.lit(0)), threshold, lambda acc, _x: acc, keep)
