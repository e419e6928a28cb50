"""Least squares from moment sums: the cross products of p columns are one mergeable aggregate, and only
that p x p table meets a solver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.scalars import div


@F.pandas_udf(ArrayType(DoubleType()))
def solve_normal(gram: pd.Series, xty: pd.Series) -> pd.Series:
    """Minimum-norm solution of the normal equations, columns scaled first for conditioning."""
    out = []
    for g, b in zip(gram, xty):
        b = np.asarray(b, dtype=float)
        g = np.asarray(g, dtype=float).reshape(len(b), len(b))
        if not (np.isfinite(g).all() and np.isfinite(b).all()):
            out.append(None)
            continue
        d = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        out.append((np.linalg.lstsq(g / np.outer(d, d), b / d, rcond=1e-12)[0] / d).tolist())
    return pd.Series(out)


def design(columns: Sequence[str], intercept: bool) -> list[Column]:
    return [*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") for c in columns]]


def complete(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def least_squares(df: DataFrame, xs: Sequence[str], y: str, *, keys: Sequence[str] = (), intercept: bool = False) -> DataFrame:
    """(keys, coef) per group over rows where all columns are present; coef follows [1, *xs]."""
    cols = design(xs, intercept)
    p = len(cols)
    target = F.col(y).cast("double")
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(cols[i] * target).alias(f"b{i}") for i in range(p)]
    m = df.where(complete([*xs, y])).groupBy(*keys).agg(*sums)
    gram = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    return m.select(*keys, solve_normal(gram, F.array(*[F.col(f"b{i}") for i in range(p)])).alias("coef"))


def fitted(xs: Sequence[str], intercept: bool, coef: str = "coef") -> Column:
    total = F.lit(0.0)
    for i, c in enumerate(design(xs, intercept)):
        total = total + F.col(coef)[i] * c
    return total


def residual_cosine(df: DataFrame, factors: Sequence[str], controls: Sequence[str], y: str) -> DataFrame:
    """(factor, cos): uncentred cosine with y of what is left of a factor after regression on the
    controls with intercept; null where the controls explain it fully. Two passes over the data."""
    rows = df.where(complete([*factors, *controls, y]))
    cols = design(controls, True)
    p = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(cols[i] * F.col(f)).alias(f"b_{f}_{i}") for f in factors for i in range(p)]
    m = rows.agg(*sums)
    gram = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    m = m.select(*[solve_normal(gram, F.array(*[F.col(f"b_{f}_{i}") for i in range(p)])).alias(f"w_{f}") for f in factors])
    withw = rows.crossJoin(F.broadcast(m))

    def one(f: str) -> Column:
        fit = F.lit(0.0)
        for i, c in enumerate(cols):
            fit = fit + F.col(f"w_{f}")[i] * c
        r = F.col(f) - fit
        rr, ff = F.sum(r * r), F.sum(F.col(f) * F.col(f))
        explained = F.sqrt(rr) < 1e-9 * F.sqrt(ff + 1e-30)
        cos = div(F.sum(r * F.col(y)), F.sqrt(rr * F.sum(F.col(y) * F.col(y))))
        return F.struct(F.lit(f).alias("factor"), F.when(~explained, cos).alias("cos"))

    wide = withw.agg(*[one(f).alias(f) for f in factors])
    return wide.select(F.explode(F.array(*[F.col(f) for f in factors])).alias("_r")).select("_r.*")
