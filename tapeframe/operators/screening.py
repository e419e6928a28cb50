"""Period-by-period screening of factors and ways to combine them. All per-period numbers come from one aggregation by (period,
factor), combined before its exchange: a few sums per period, factor and task are all that is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.aggregates import cosine, pearson
from ..functions.scalars import div
from .ordered import Hot
from .quantiles import cells, with_ranks
from .regression import least_squares

MIN_ROWS = 100


def guarded_cosine(p: str | Column, y: str | Column, min_rows: int = MIN_ROWS) -> Column:
    """Cosine of a period, null with `min_rows` pairs or fewer."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (p, y))
    return F.when(F.count(a * b) > min_rows, cosine(a, b))


def _long(wide: DataFrame, keys: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias("r")) for n in names]))
    return wide.select(*keys, rows.alias("_x")).select(*keys, f"_x.{label}", "_x.r.*")


def _by_factor(df: DataFrame, factors: Sequence[str], target: str, period: str) -> GroupedData:
    """Rows of every factor as `_v` by (period, factor): four sums instead of four per factor, so plans don't grow with the factors. Every factor
    has a group in every period."""
    names = F.array(*[F.lit(f) for f in factors])
    long = cells(df, factors, [period, target], nulls=True).withColumn("factor", F.get(names, F.col("_c")))
    return long.groupBy(period, "factor")


def period_scores(df: DataFrame, factors: Sequence[str], *, target="target", period="month", min_rows=MIN_ROWS) -> DataFrame:
    """(period, factor, corr, corr_sign, corr_abs, cos)."""
    y = F.col(target)
    return _by_factor(df, factors, target, period).agg(
        pearson("_v", y, min_rows).alias("corr"), pearson("_v", F.signum(y), min_rows).alias("corr_sign"),
        pearson("_v", F.abs(y), min_rows).alias("corr_abs"), guarded_cosine("_v", y, min_rows).alias("cos"),
    )


def screen(scores: DataFrame) -> DataFrame:
    """One row per factor over its periods. A period without a correlation counts as not positive."""
    return scores.groupBy("factor").agg(
        F.avg("corr").alias("corr_mean"), F.stddev_pop("corr").alias("corr_std"),
        F.avg(F.coalesce(F.col("corr") > 0, F.lit(False)).cast("double")).alias("pos_frac"),
        F.avg("cos").alias("cos_mean"), F.stddev_pop("cos").alias("cos_std"),
        F.avg("corr_sign").alias("corr_sign_mean"), F.avg("corr_abs").alias("corr_abs_mean"),
    )


def top_factors(screened: DataFrame, by: str, k: int) -> DataFrame:
    return screened.orderBy(F.desc_nulls_last(by), F.asc("factor")).limit(k)


def period_stability(df: DataFrame, factors: Sequence[str], *, target="target", period="month") -> DataFrame:
    """(factor, cos_mean, cos_std, pos_frac, neg_periods) over periods where the cosine exists."""
    long = _by_factor(df, factors, target, period).agg(cosine("_v", target).alias("cos"))
    return long.where(F.col("cos").isNotNull()).groupBy("factor").agg(
        F.avg("cos").alias("cos_mean"), F.stddev_pop("cos").alias("cos_std"),
        F.avg((F.col("cos") > 0).cast("double")).alias("pos_frac"), F.count_if(F.col("cos") < 0).alias("neg_periods"),
    )


def correlation_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], min_rows: int = MIN_ROWS, cond: Column | None = None) -> DataFrame:
    """(a, b, corr) for the given column pairs, all in one aggregation."""
    pick = (lambda c: F.col(c)) if cond is None else (lambda c: F.when(cond, F.col(c)))
    wide = df.agg(*[pearson(pick(a), pick(b), min_rows).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ]))
    return wide.select(rows.alias("_r")).select("_r.*")


def correlation_matrix(df: DataFrame, columns: Sequence[str], min_rows: int = 2) -> DataFrame:
    return correlation_pairs(df, [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]], min_rows)


def redundant(df: DataFrame, factors: Sequence[str], anchors: Sequence[str], above: float = 0.7, min_rows=MIN_ROWS) -> DataFrame:
    pairs = [(f, a) for f in factors for a in anchors]
    return correlation_pairs(df, pairs, min_rows).where(F.abs("corr") > above)


def keep_or_drop(table: DataFrame, *, dead: float = 0.002, steady: float = 0.55) -> DataFrame:
    """Adds verdict: drop, weak or keep, from cos_last, cos_full and pos_frac."""
    strong = F.greatest(F.abs("cos_last"), F.abs("cos_full"))
    unsteady = F.col("pos_frac").isNull() | (F.col("pos_frac") < steady)
    verdict = F.when((strong < dead) & unsteady, "drop").when(strong < dead * 2.5, "weak").otherwise("keep")
    return table.withColumn("verdict", verdict)


def screen_channels(
    reduced: DataFrame, channels: Sequence[str], *, target="target", period="month", filled: float = 0.01, dead: float = 0.002, tiny: float = 1e-9,
) -> DataFrame:
    """(factor, nonzero, cos_last, cos_full, pos_frac, verdict) per grid channel, from its means over all bins (`_full`) and over the
    last two (`_last2`). A channel that is constant or non-zero in less than `filled` of the episodes is dead; signs per period are
    those of the whole-window mean. A mean below `tiny` counts as zero: terms that cancel leave a rest that depends on their order.

    One aggregation over (channel, period) with mergeable sums; a second one over its few rows."""
    pair = lambda c: F.struct(F.lit(c).alias("factor"), F.col(f"{c}_full").alias("full"), F.col(f"{c}_last2").alias("last"))
    long = reduced.select(period, target, F.inline(F.array(*[pair(c) for c in channels])))
    products = {"ft": F.col("full") * F.col(target), "lt": F.col("last") * F.col(target), "ff": F.col("full") * F.col("full"), "ll": F.col("last") * F.col("last"), "tt": F.col(target) * F.col(target)}
    part = long.groupBy("factor", period).agg(
        *[F.sum(x).alias(c) for c, x in products.items()], F.count(F.lit(1)).alias("n"), F.count_if(F.abs("full") >= tiny).alias("some"),
        F.min("full").alias("lo"), F.max("full").alias("hi"),
    )
    cos = lambda xy, xx, yy: div(xy, F.sqrt(xx * yy))
    part = part.withColumn("cos", cos(F.col("ft"), F.col("ff"), F.col("tt")))
    whole = part.groupBy("factor").agg(
        div(F.sum("some"), F.sum("n")).alias("nonzero"), (F.min("lo") == F.max("hi")).alias("constant"),
        cos(F.sum("lt"), F.sum("ll"), F.sum("tt")).alias("cos_last"), cos(F.sum("ft"), F.sum("ff"), F.sum("tt")).alias("cos_full"),
        F.avg(F.when(F.col("cos").isNotNull(), (F.col("cos") > 0).cast("double"))).alias("pos_frac"),
    )
    empty = F.col("constant") | (F.col("nonzero") < filled)
    return keep_or_drop(whole, dead=dead).withColumn("verdict", F.when(empty, "dead").otherwise(F.col("verdict"))).drop("constant")


# ---- composites ---------------------------------------------------------------------------------


def rank_columns(
    df: DataFrame, factors: Sequence[str], *, keys: Sequence[str], hot: Hot | None, limit: int, prefix: str = "r_", min_rows: int = 2
) -> DataFrame:
    """Adds r_<factor>, the rank within `keys` mapped to [-1, 1]."""
    return with_ranks(df, keys, {f"{prefix}{f}": (f, True) for f in factors}, hot=hot, limit=limit, min_rows=min_rows)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the non-null columns, null if there is none."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return div(total, n)


def sign_vote(columns: Sequence[Column]) -> Column:
    return row_mean([F.signum(c) for c in columns])


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Weighted mean of columns, weights renormalised over the non-null ones."""
    total = sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    mass = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return div(total, mass)


def modulation_grid(df: DataFrame, combo: str, sigma: str, ks: Sequence[float], *, bound: str | None = None, target="target", period="month", min_rows=MIN_ROWS) -> DataFrame:
    """(k, cos_mean, cos_min, neg): per-period cosine of combo·(1 + k·sigma), summarised per k. With `bound`, a column that knows the amplitude, one
    more row has the cosine of combo·bound, which no sigma can be expected to pass; its k is null."""
    forms = {f"k{i}": (F.lit(float(k)), F.col(combo) * (1 + F.lit(float(k)) * F.col(sigma))) for i, k in enumerate(ks)}
    if bound:
        forms["bound"] = (F.lit(None).cast("double"), F.col(combo) * F.col(bound))
    one = lambda n, k, p: F.struct(k.alias("k"), guarded_cosine(p, F.col(target), min_rows).alias("cos")).alias(n)
    wide = df.groupBy(period).agg(*[one(n, k, p) for n, (k, p) in forms.items()])
    return _long(wide, [period], list(forms), "_n").groupBy("k").agg(
        F.avg("cos").alias("cos_mean"), F.min("cos").alias("cos_min"), F.count_if(F.col("cos") < 0).alias("neg")
    )


def period_weights(df: DataFrame, factors: Sequence[str], *, target="target", period="month") -> DataFrame:
    """(period, factor, w, share): least-squares weights per period and their share of the sum."""
    fit = least_squares(df, factors, target, keys=[period])
    total = F.aggregate("coef", F.lit(0.0), lambda a, x: a + x)
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.col("coef")[i].alias("w"), div(F.col("coef")[i], total).alias("share"))
        for i, f in enumerate(factors)
    ]))
    return fit.select(period, rows.alias("_r")).select(period, "_r.*")


def weight_drift(weights: DataFrame, activity: DataFrame, *, period="month", edge: int = 20) -> DataFrame:
    """Per factor: share mean, std, min, max, negative periods, mean over the first and last `edge`
    periods, and correlation with `activity(period, act)`. Weights have one row per period and factor."""
    w = Window.partitionBy("factor").orderBy(period)
    n = F.count(F.lit(1)).over(Window.partitionBy("factor"))
    df = weights.join(activity, period).select("*", F.row_number().over(w).alias("_i"), n.alias("_n"))
    return df.groupBy("factor").agg(
        F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"), F.min("share").alias("min"), F.max("share").alias("max"),
        F.count_if(F.col("w") < 0).alias("negative"),
        F.avg(F.when(F.col("_i") <= edge, F.col("share"))).alias("early"),
        F.avg(F.when(F.col("_i") > F.col("_n") - edge, F.col("share"))).alias("late"),
        pearson("share", "act", 2).alias("corr_activity"),
    )
