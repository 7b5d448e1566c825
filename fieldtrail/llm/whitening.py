"""Operator 11: whitening of embeddings by the upper triangle of their covariance, summed in Spark.

For every pair of dimensions i <= j one generated expression sums the centred products; all of them are one aggregation, so what leaves
a task is one row of d(d+1)/2 sums. The driver gets that one row, puts the matrix together and has LAPACK decompose it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import stage


def quantised(rows: DataFrame, vec_col: str = "embedding", scale: int = 256, name: str = "x") -> DataFrame:
    """``rows`` with ``name``: floor(scale * entry) of each entry as long. Rows whose vector is null or holds null or non-finite entries go.

    The dimension is the largest length among the rows that are left; a shorter vector lacks entries, which counts as null entries. Empty
    vectors go too. Entries beyond a long become the nearest long.
    """
    wide = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = rows.where(F.col(vec_col).isNotNull() & F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    dim = fine.agg(F.max(F.size(vec_col))).first()[0] or 0
    return fine.where((F.size(vec_col) == dim) & (F.size(vec_col) > 0)).withColumn(name, F.transform(wide, lambda c: F.floor(c * scale)))


@dataclass
class Whitening:
    """What is fitted: bounded by the square of the dimension, whatever the number of rows."""

    n: int
    sums: list[int]
    reach: int  # the largest |n*x - S| of any entry
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float = 0.0

    def projections(self, x: str, components: int) -> list:
        """Columns: the whitened value of array column ``x`` for each component; null where a component has no variance."""
        least = self.trace * 1e-12
        out = []
        for k in range(min(components, len(self.sums))):
            e = float(self.values[k])
            terms = [(_entry(x, i) - F.lit(s / self.n)) * F.lit(float(self.vectors[i, k])) for i, s in enumerate(self.sums)]
            out.append(_tree(terms) / F.lit(e**0.5) if e > least else F.lit(None).cast("double"))
        return out


def _entry(x: str, i: int):
    """Entry ``i`` of a whole vector. It is never null, and saying so spares the many sums their null checks."""
    return F.coalesce(F.get(F.col(x), F.lit(i)), F.lit(0).cast("long"))


def _tree(terms: list):
    """The sum of columns as a balanced tree."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
    return terms[0]


def fit(vectors: DataFrame, x: str = "x", components: int = 4, pairs_at_once: int = 10_000) -> Whitening | None:
    """Fits on each distinct vector of ``vectors`` once; None where there is none. Copies are combined before the shuffle.

    One aggregation has all sums up to ``pairs_at_once`` pairs (140 dimensions); wider vectors take several, each of them over all rows.
    """
    distinct = stage(vectors.select(F.col(x).alias("x")).distinct())
    first = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    n, dim = first[0], first[1] or 0
    if not n:
        return None
    facts = distinct.agg(*(f(_entry("x", i).cast("decimal(28,0)")) for f in (F.sum, F.min, F.max) for i in range(dim))).first()
    sums, least, most = ([int(v) for v in facts[k * dim : (k + 1) * dim]] for k in range(3))
    reach = max(abs(n * x - s) for ends in (least, most) for x, s in zip(ends, sums, strict=True))
    centred = distinct.select(*((_entry("x", i) - F.lit(s / n)).alias(f"c{i}") for i, s in enumerate(sums)))
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    matrix = np.zeros((dim, dim))
    for k in range(0, len(pairs), pairs_at_once):
        chosen = pairs[k : k + pairs_at_once]
        row = centred.selectExpr(*(f"sum(c{i} * c{j})" for i, j in chosen)).first()
        for (i, j), value in zip(chosen, row, strict=True):
            matrix[i, j] = matrix[j, i] = value / n
    values, vecs = np.linalg.eigh(matrix)
    out = Whitening(n, sums, reach, values[::-1], vecs[:, ::-1], float(np.trace(matrix)))
    white = distinct.select(*(w.alias(f"w{k}") for k, w in enumerate(out.projections("x", components))))
    some = [k for k in range(len(white.columns)) if out.values[k] > out.trace * 1e-12]
    if some:
        got = white.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i in some for j in some if i <= j)).first()
        out.identity_error = max(abs(v - (i == j)) for v, (i, j) in zip(got, ((i, j) for i in some for j in some if i <= j), strict=True))
    return out


def whiten(rows: DataFrame, vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each row with a whole vector and each of the first ``components`` components.

    Adds ``component`` (from 1), ``n``, ``deviation`` (decimal, exact: sum of (n*x-S)^2), ``whitened``, ``explained`` and
    ``identity_error``, in place of such columns of ``rows``; fewer dimensions than ``components`` give fewer components. A component
    without variance (all vectors equal, or one alone) has a null ``whitened`` and is left out of the identity error; ``explained`` is 0
    where there is no variance at all. Repeated rows stay and count once in the fit; equal eigenvalues come in LAPACK's order. An empty
    table, or one without a whole vector, gives no rows. Copies, hot ids and null ids need nothing: rows never meet each other.
    """
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    carried = [c for c in rows.columns if c not in new]
    tag = "_" * (1 + max(map(len, rows.columns)))
    xs, parts = "x" + tag, "parts" + tag
    found = quantised(rows, vec_col, name=xs)
    model = fit(found, xs, components)
    if model is None:
        model = Whitening(1, [0], 0, np.zeros(1), np.ones((1, 1)), 0.0)
    if len(model.sums) * model.reach**2 < 1 << 63 and model.reach + max(map(abs, model.sums)) < 1 << 63:  # proven to fit a long
        off = [_entry(xs, i) * F.lit(model.n).cast("long") - F.lit(s).cast("long") for i, s in enumerate(model.sums)]
        deviation = _tree([o * o for o in off]).cast("decimal(38,0)")
    else:
        off = [_entry(xs, i).cast("decimal(19,0)") * F.lit(model.n).cast("decimal(19,0)") - F.lit(s).cast("decimal(38,0)") for i, s in enumerate(model.sums)]
        deviation = _tree([(o.cast("decimal(19,0)") * o.cast("decimal(19,0)")).cast("decimal(38,0)") for o in off]).cast("decimal(38,0)")
    each = F.array(*(F.struct(F.lit(k + 1).alias("component"), w.alias("whitened"), F.lit(float(model.values[k] / model.trace) if model.trace else 0.0).alias("explained")) for k, w in enumerate(model.projections(xs, components))))
    out = found.select(*carried, deviation.alias("deviation" + tag), F.explode(each).alias(parts))
    return out.select(
        *carried, F.col(parts)["component"].alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation" + tag).alias("deviation"), F.col(parts)["whitened"].alias("whitened"),
        F.col(parts)["explained"].alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"),
    )
