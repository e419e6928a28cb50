"""Blending of member predictions. The cosine of a weighted sum depends on the data only through second
moments, so any grid of weights is evaluated on one small moment table per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div


def unit_columns(df: DataFrame, columns: Sequence[str], prefix: str = "u_") -> DataFrame:
    """Each column centred and scaled to length 1 over the whole table; all 0 where it is constant."""
    mom = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.sqrt(F.var_pop(c) * F.count(c)).alias(f"_n_{c}") for c in columns],
    )
    out = [F.coalesce(div(F.col(c) - F.col(f"_m_{c}"), f"_n_{c}"), F.lit(0.0)).alias(f"{prefix}{c}") for c in columns]
    return df.crossJoin(F.broadcast(mom)).select(*df.columns, *out)


def align(members: Sequence[DataFrame], key: str = "sample_id") -> DataFrame:
    """Inner join of prediction tables that must hold the same unique episodes; raises otherwise."""
    base = members[0]
    for m in members[1:]:
        base = base.join(m, key, "full")
    values = [c for c in base.columns if c != key]
    miss, dup = base.agg(
        F.count_if(F.exists(F.array(*[F.col(c).isNull() for c in values]), lambda x: x)),
        F.count(F.lit(1)) - F.count_distinct(key),
    ).first()
    if miss or dup:
        raise ValueError(f"members do not align: {miss} episodes missing somewhere, {dup} duplicates")
    return base


def blended(columns: Sequence[str], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + F.lit(float(w)) * F.col(c)
    return total


def moments(df: DataFrame, members: Sequence[str], y: str = "target", keys: Sequence[str] = ("month",)) -> DataFrame:
    """Per group: member products m0_0, m0_1, ..., cross products with the target c0, ..., and yy."""
    n = len(members)
    return df.groupBy(*keys).agg(
        *[F.sum(F.col(members[i]) * F.col(members[j])).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)],
        *[F.sum(F.col(members[i]) * F.col(y)).alias(f"c{i}") for i in range(n)],
        F.sum(F.col(y) * F.col(y)).alias("yy"),
    )


def blend_cosine(weights: Sequence[Column]) -> Column:
    """Cosine of the weighted sum, from a moment row."""
    n = len(weights)
    num = sum((weights[i] * F.col(f"c{i}") for i in range(n)), F.lit(0.0))
    den = sum(
        ((1.0 if i == j else 2.0) * weights[i] * weights[j] * F.col(f"m{i}_{j}") for i in range(n) for j in range(i, n)),
        F.lit(0.0),
    )
    return div(num, F.sqrt(F.greatest(den, F.lit(0.0)) * F.col("yy")))


def weight_grid(mom: DataFrame, axes: Sequence[Sequence[float]], keys: Sequence[str] = ("month",)) -> DataFrame:
    """(keys, ordinal, w1, ..., cos) for every grid point; the first member has weight 1. The input has
    one row per period, so the expansion is periods x grid points."""
    df = mom.withColumn("ordinal", F.lit(0))
    ws = []
    for i, axis in enumerate(axes, start=1):
        pos = F.posexplode(F.array(*[F.lit(float(a)) for a in axis])).alias("_p", f"w{i}")
        df = df.select("*", pos).withColumn("ordinal", F.col("ordinal") * len(axis) + F.col("_p")).drop("_p")
        ws.append(f"w{i}")
    cos = blend_cosine([F.lit(1.0), *[F.col(w) for w in ws]])
    return df.select(*keys, "ordinal", *ws, cos.alias("cos"))


def best_weights(grid: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    """Best grid point per group, the first of the grid on ties."""
    ws = [c for c in grid.columns if c.startswith("w")]
    pick = F.max_by(F.struct(*ws, "cos"), F.struct("cos", -F.col("ordinal")))
    return grid.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")


def pooled_weights(best: DataFrame) -> DataFrame:
    """Median over periods of each weight (the pooled weight) and its population std (stability)."""
    ws = [c for c in best.columns if c.startswith("w")]
    return best.agg(
        *[F.percentile(w, F.lit(0.5)).alias(w) for w in ws], *[F.stddev_pop(w).alias(f"{w}_std") for w in ws],
        F.avg("cos").alias("cos_best"),
    )


def pooled_scores(mom: DataFrame, pooled: DataFrame, keys: Sequence[str] = ("month",)) -> DataFrame:
    ws = [c for c in pooled.columns if c.startswith("w") and not c.endswith("_std")]
    j = mom.crossJoin(F.broadcast(pooled.select(*ws)))
    return j.select(*keys, blend_cosine([F.lit(1.0), *[F.col(w) for w in ws]]).alias("cos_pooled"))


def sensitivity(mom: DataFrame, axes: Sequence[Sequence[float]], keys: Sequence[str] = ("month",)) -> DataFrame:
    """Mean cosine over periods at every grid point."""
    grid = weight_grid(mom, axes, keys)
    ws = [c for c in grid.columns if c.startswith("w")]
    return grid.groupBy(*ws).agg(F.avg("cos").alias("cos"))


# ---- power-law rescale --------------------------------------------------------------------------


def centred_log(df: DataFrame, unit: str, out: str = "lu") -> DataFrame:
    mean = df.agg(F.avg(F.ln(unit)).alias("_m"))
    return df.crossJoin(F.broadcast(mean)).withColumn(out, F.ln(unit) - F.col("_m")).drop("_m")


def power_moments(df: DataFrame, p: str, y: str, lu: str, exponents: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, w, py, pp, yy) of p·exp(w·lu). Rows with the same lu are summed first, so the grid of
    exponents multiplies distinct units and not episodes."""
    P, Y = F.col(p), F.col(y)
    per_unit = df.groupBy(*keys, lu).agg(F.sum(P * Y).alias("A"), F.sum(P * P).alias("B"), F.sum(Y * Y).alias("Y"))
    w = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("w")
    g = per_unit.select(*keys, lu, "A", "B", "Y", w)
    e = F.exp(F.col("w") * F.col(lu))
    return g.groupBy(*keys, "w").agg(F.sum(F.col("A") * e).alias("py"), F.sum(F.col("B") * e * e).alias("pp"), F.sum("Y").alias("yy"))


def best_power(mom: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exponent with the best cosine per group, the smallest on ties."""
    cos = div("py", F.sqrt(F.col("pp") * F.col("yy")))
    pick = F.max_by(F.struct("w", cos.alias("cos")), F.struct(cos, -F.col("w")))
    return mom.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")


def held_out_power(fold_moments: DataFrame, fold: str = "fold") -> DataFrame:
    """Per fold the best exponent on all other folds: their moments are the total minus the fold's own."""
    total = fold_moments.groupBy("w").agg(*[F.sum(c).alias(f"t_{c}") for c in ("py", "pp", "yy")])
    rest = fold_moments.join(total, "w").select(fold, "w", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("py", "pp", "yy")])
    return best_power(rest, [fold])


def power_rescaled(p: str, unit: str, w: float) -> Column:
    return F.col(p) * F.pow(F.col(unit), F.lit(float(w)))


def max_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """max |unit(a) - unit(b)| over the table."""
    u = unit_columns(df, [a, b])
    return u.agg(F.max(F.abs(F.col(f"u_{a}") - F.col(f"u_{b}"))).alias("worst"))
