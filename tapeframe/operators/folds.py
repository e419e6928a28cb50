"""Period folds, training-only preparation, out-of-fold evaluation and tree models.

Statistics of 'all other folds' come from counts that subtract: every column's values are counted once per own fold, and what trains
a fold is all counts less its own. One running total per column then has the ranks of all training folds at once, so no row is
copied, and plans grow neither with bins nor with columns. Moments are merged over the few rows of a fold table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import cosine
from ..functions.scalars import asinh, clip, col, div
from ..sources.shared import settle
from . import intervals
from .encodings import encoding
from .ordered import Hot, running_total
from .quantiles import cells

FOLDS, TARGET_SCALE, Z_CLIP, TICK_CLIP, TICK_FLOOR, EDGE_BINS = 6, 1000.0, 5.0, 256.0, 1e-9, 48
MANY = 8  # columns from which three readings of the rows cost less than an exchange of their values


def period_folds(periods: DataFrame, period: str = "month", step: int = FOLDS) -> DataFrame:
    """(period, idx, fold): dense index of the period and fold = idx % step. One row per period."""
    distinct = periods.select(period).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(period)
    idx = (F.row_number().over(w) - 1).cast("int")
    return distinct.select(period, idx.alias("idx")).withColumn("fold", (F.col("idx") % step).cast("int"))


def single_period_folds(periods: DataFrame, period: str = "month", start: int = 2, step: int = FOLDS) -> DataFrame:
    """(fold, val): every step-th period from `start` is the validation set of one fold; all other
    periods train."""
    idx = period_folds(periods, period, step)
    chosen = idx.where((F.col("idx") >= start) & ((F.col("idx") - start) % step == 0))
    return chosen.select(F.floor((F.col("idx") - start) / step).cast("int").alias("fold"), F.col(period).alias("val"))


def with_fold(df: DataFrame, folds: DataFrame, period: str = "month") -> DataFrame:
    return df.join(F.broadcast(folds.select(period, "fold")), period)


def training_rows(df: DataFrame, folds: int, fold: str = "fold", out: str = "val_fold") -> DataFrame:
    """Each row once for every fold it trains."""
    return df.withColumn(out, F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))))


def training_quantiles(df: DataFrame, columns: Sequence[str], folds: int, bins: int, at: Sequence[int], *, hot: Hot | None, limit: int) -> DataFrame:
    """(val_fold, _c, i, value): for every validation fold and column (by number) the linear quantiles i/bins of its training rows, for the i in
    `at`. Nulls are left out; a column without training values has no rows. `hot`: given when a fold has more training rows than the limit."""
    if hot is not None and len(columns) >= MANY:
        ranked = _ranked_near(df, columns, folds, bins, at, hot, limit)
    else:
        ranked = _ranked(df, columns, folds, hot, limit)
    by_fold = F.array(*[F.struct(F.lit(k).alias("val_fold"), F.col(f"_m{k}").alias("m"), F.col(f"_b{k}").alias("b"), F.col(f"_n{k}").alias("n")) for k in range(folds)])
    # nearly no value lies next to a quantile: the others go by plain arithmetic, before a row is copied per fold and searched for its quantiles
    beside = lambda b, m, n: (m > 0) & _may_cover(b, m, n, bins, min(at), max(at))
    some = reduce(Column.__or__, [beside(F.col(f"_b{k}"), F.col(f"_m{k}"), F.col(f"_n{k}")) for k in range(folds)])
    few = ranked.where(some)
    each = few.select("_c", "_v", F.explode(by_fold).alias("x")).select("_c", "_v", "x.*").where(beside(F.col("b"), F.col("m"), F.col("n")))
    # quantile i lies between ranks floor and ceil of (n-1)(i/bins); a value covers the ranks b .. b+m-1
    per_rank = F.greatest(F.col("n") - 1, F.lit(1))
    low = F.greatest(F.expr(f"(b - 1) * {bins}") / per_rank - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(F.expr(f"(b + m) * {bins}") / per_rank), F.lit(bins)).cast("int")
    place = lambda i: F.expr("n - 1") * (i / F.lit(float(bins)))
    covered = lambda rank: (rank >= F.col("b")) & (rank < F.col("b") + F.col("m"))
    wanted = F.array(*[F.lit(i) for i in sorted(set(at))])
    near = F.filter(F.array_intersect(F.sequence(F.least(low, high), high), wanted), lambda i: covered(F.floor(place(i))) | covered(F.ceil(place(i))))
    hits = each.select("_c", "val_fold", "n", "b", "m", "_v", F.explode(near).alias("i"))
    at_i = place(F.col("i"))
    ends = hits.groupBy("val_fold", "_c", "i").agg(
        F.max(F.when(covered(F.floor(at_i)), F.col("_v"))).alias("lo"), F.max(F.when(covered(F.ceil(at_i)), F.col("_v"))).alias("hi"), F.max("n").alias("n")
    )
    return ends.select("val_fold", "_c", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * (at_i - F.floor(at_i))).alias("value"))


def _ranked(df: DataFrame, columns: Sequence[str], folds: int, hot: Hot | None, limit: int) -> DataFrame:
    """(_c, _v, and per fold _m copies of the value, _b values below it and _n values of the column among its training rows)."""
    counts = cells(df, columns, ["fold"]).groupBy("_c", "_v").agg(
        *[F.count_if(F.col("fold") != k).alias(f"_m{k}") for k in range(folds)]
    )
    wide = None
    if hot is not None:
        numbers = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("_c"))
        wide = Hot(numbers, max(hot.rows, 1) * len(columns))
    before = {f"_b{k}": f"_m{k}" for k in range(folds)}
    ranked = running_total(counts, ["_c"], "_v", before, hot=wide, limit=limit)
    sizes = counts.groupBy("_c").agg(*[F.sum(f"_m{k}").alias(f"_n{k}") for k in range(folds)])  # a row per column
    return ranked.join(F.broadcast(sizes), "_c")


def _ranked_near(df: DataFrame, columns: Sequence[str], folds: int, bins: int, at: Sequence[int], hot: Hot, limit: int) -> DataFrame:
    """`_ranked` without the values of intervals that hold no wanted quantile of any fold (operators/intervals.py): they are counted where they lie and
    never exchanged. The rows are read three times; a number per column, fold and interval comes to the driver."""
    cuts = intervals.cut(df, columns, hot.rows // max(folds - 1, 1))
    train = [intervals.training(n, folds) for n in intervals.counted(df, columns, folds, cuts)]
    wanted = [intervals.holding(t, bins, at) for t in train]
    places, large = [], []
    for c, (t, some) in enumerate(zip(train, wanted)):
        below, n = (np.cumsum(t, axis=1) - t).tolist(), t.sum(axis=1).tolist()
        places += [(c, int(i), *[b[i] for b in below], *n) for i in np.flatnonzero(some)]
        large += [(c, int(i), int(most)) for i, most in enumerate(t.max(axis=0)) if some[i] and most > limit]
    spark, key = df.sparkSession, "_c int, _span int"
    each = [f"_a{k}" for k in range(folds)], [f"_n{k}" for k in range(folds)]
    table = spark.createDataFrame(places, ", ".join([key, *[f"{c} long" for c in (*each[0], *each[1])]]))
    wide = Hot(spark.createDataFrame([x[:2] for x in large], key), sum(x[2] for x in large)) if large else None
    counts = intervals.value_counts(df, columns, folds, cuts, wanted)
    ranked = running_total(counts, ["_c", "_span"], "_v", {f"_b{k}": f"_m{k}" for k in range(folds)}, hot=wide, limit=limit)
    ranked = ranked.join(F.broadcast(table), ["_c", "_span"])
    return ranked.select("_c", "_v", *[x for k in range(folds) for x in (F.col(f"_m{k}"), (F.col(f"_a{k}") + F.col(f"_b{k}")).alias(f"_b{k}"), F.col(f"_n{k}"))])


def _may_cover(b: Column, m: Column, n: Column, bins: int, first: int, last: int) -> Column:
    """Whether ranks b .. b+m-1 of n may hold the floor or ceil of (n-1)(i/bins) for an i from `first` to `last`: whether an i lies between the ranks
    around them, b-1 and b+m, with some room for rounding."""
    per_rank, room = F.greatest(n - 1, F.lit(1)), F.lit(1e-6)
    after, before = (b - 1) * bins / per_rank - room, (b + m) * bins / per_rank + room
    i = F.greatest(F.floor(after) + 1, F.lit(first))
    return (i < before) & (i <= last)


def fold_statistics(df: DataFrame, columns: Sequence[str], folds: int, *, hot: Hot | None, limit: int) -> DataFrame:
    """Per validation fold, from its training rows: median, mean and population std after median fill
    (std 1 for constants). Columns <c>_med, <c>_mu, <c>_sd."""
    med = training_quantiles(df, columns, folds, 2, [1], hot=hot, limit=limit).select("val_fold", "_c", F.col("value").alias("med"))
    # per fold and column, then merged over the folds that train: at most folds x folds x columns rows
    own = cells(df, columns, ["fold"]).groupBy("fold", "_c").agg(F.count("_v").alias("k"), F.avg("_v").alias("a"), F.var_pop("_v").alias("v"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    rows = training_rows(df.groupBy("fold").agg(F.count(F.lit(1)).alias("rows")), folds).groupBy("val_fold").agg(F.sum("rows").alias("n"))
    each = training_rows(own, folds)
    group = Window.partitionBy("val_fold", "_c")
    each = each.withColumn("mean", F.sum(F.col("k") * F.col("a")).over(group) / F.sum("k").over(group))
    square = lambda x: F.pow(x, F.lit(2.0))
    merged = each.groupBy("val_fold", "_c").agg(
        F.sum("k").alias("k"), F.max("mean").alias("a"), (F.min("lo") == F.max("hi")).alias("constant"), F.sum(F.col("k") * (F.col("v") + square(F.col("a") - F.col("mean")))).alias("m2")
    )
    n, k, a, m = F.col("n"), F.col("k"), F.col("a"), F.col("med")
    # two groups: the present values and the (n - k) copies of the median
    sd = F.sqrt((F.col("m2") + k * (n - k) / n * square(a - m)) / n)
    long = merged.join(med, ["val_fold", "_c"]).join(F.broadcast(rows), "val_fold").select(
        "val_fold", "_c", "med", ((k * a + (n - k) * m) / n).alias("mu"), F.when(F.col("constant"), F.lit(1.0)).otherwise(sd).alias("sd")
    )
    found = long.groupBy("val_fold").agg(
        *[F.max(F.when(F.col("_c") == j, F.col(x))).alias(f"{c}_{x}") for j, c in enumerate(columns) for x in ("med", "mu", "sd")]
    )
    return rows.select("val_fold").join(found, "val_fold", "left")


def standardise(df: DataFrame, stats: DataFrame, columns: Sequence[str], on: Column, bound: float = Z_CLIP) -> DataFrame:
    """Median fill, z-score and clip with the statistics of the fold that `on` names."""
    j = df.join(F.broadcast(stats), on)
    z = lambda c: clip((F.coalesce(F.col(c), F.col(f"{c}_med")) - F.col(f"{c}_mu")) / F.col(f"{c}_sd"), -bound, bound)
    keep = [F.col(c) for c in df.columns if c not in columns]
    return j.select(*keep, *[z(c).alias(c) for c in columns])


def unit_classes(df: DataFrame, medians: DataFrame, classes: dict[str, Sequence[str]], on: Column, unit: str = "U_s") -> DataFrame:
    """Median fill, then per class: tick x/U clipped, tick_asinh asinh(x/U), asinh asinh(x), raw x; all
    clipped at the end."""
    u = F.greatest(F.col(unit), F.lit(TICK_FLOOR))
    forms = {
        "tick": lambda x: div(x, u), "tick_asinh": lambda x: asinh(div(x, u)), "asinh": asinh, "raw": lambda x: x,
    }
    names = [c for cols in classes.values() for c in cols]
    if len(set(names)) != len(names):
        raise ValueError("a column is in two unit classes")
    j = df.join(F.broadcast(medians), on)
    done = [
        clip(forms[kind](F.coalesce(F.col(c).cast("double"), F.col(f"{c}_med"))), -TICK_CLIP, TICK_CLIP).alias(c)
        for kind, cols in classes.items() for c in cols
    ]
    return j.select(*[F.col(c) for c in df.columns if c not in names], *done)


def quantile_edges(df: DataFrame, columns: Sequence[str], folds: int, *, bins: int = EDGE_BINS, hot: Hot | None, limit: int) -> DataFrame:
    """(val_fold, factor, edges): the distinct quantile edges of each column over each fold's training rows; a constant column gets
    [x-1, x+1]."""
    found = training_quantiles(df, columns, folds, bins, range(bins + 1), hot=hot, limit=limit)
    edges = found.groupBy("val_fold", "_c").agg(F.array_sort(F.collect_set("value")).alias("e"))
    names = F.array(*[F.lit(c) for c in columns])
    e = F.col("e")
    return edges.select("val_fold", F.get(names, F.col("_c")).alias("factor"), F.when(F.size(e) == 1, F.array(e[0] - 1, e[0] + 1)).otherwise(e).alias("edges"))


def long_factors(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, factor, x): one row per row and column with a value."""
    names = F.array(*[F.lit(c) for c in columns])
    return cells(df, columns, keep).select(*keep, F.get(names, F.col("_c")).alias("factor"), F.col("_v").alias("x"))


def piecewise_linear(x: Column, edges: Column) -> Column:
    """One number per bin: share of the bin below x; open below in the first and above in the last bin."""
    return encoding(x, edges)


def scaled_target(y: str | Column, back: bool = False) -> Column:
    c = F.col(y) if isinstance(y, str) else y
    return c / F.lit(TARGET_SCALE) if back else c * F.lit(TARGET_SCALE)


def weight_scale(df: DataFrame, folds: int, per_cent: int, *, y: str = "target", hot: Hot | None, limit: int) -> DataFrame:
    """(val_fold, tau): quantile of |y| over the training rows of each fold."""
    rows = df.select("fold", F.abs(y).alias("_ay"))
    return training_quantiles(rows, ["_ay"], folds, 100, [per_cent], hot=hot, limit=limit).select("val_fold", F.col("value").alias("tau"))


def sample_weight(y: str = "target", tau: str | Column = "tau") -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(y) / col(tau))


def fold_scores(oof: DataFrame, p: str = "pred", y: str = "target", fold: str = "fold") -> DataFrame:
    return oof.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), cosine(p, y).alias("cos"))


def oof_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("std"), F.min("cos").alias("min"),
        F.count_if(F.col("cos") < 0).alias("negative"), F.count(F.lit(1)).alias("folds"),
    )


def losses(p: str = "pred", y: str = "target", weight: Column | None = None) -> list[Column]:
    """1 - cosine, mean squared error, and weighted squared error normalised by the weight sum."""
    e = F.col(p) - F.col(y)
    w = F.lit(1.0) if weight is None else weight
    return [
        (1 - cosine(p, y)).alias("cos_loss"), F.avg(e * e).alias("mse"), div(F.sum(w * e * e), F.sum(w)).alias("weighted_mse"),
    ]


def ensemble_mean(predictions: DataFrame, key: str = "sample_id", value: str = "pred") -> DataFrame:
    """Mean over the models (folds, seeds) that predicted an episode."""
    return predictions.groupBy(key).agg(F.avg(value).alias("prediction"), F.count(F.lit(1)).alias("models"))


# ---- tree models on MLlib -----------------------------------------------------------------------


def boosted_trees(**params):
    """Least-squares boosting that stops when the validation rows gain no more. Every row and feature is used in every tree, so results do not
    depend on the partitioning."""
    from pyspark.ml.regression import GBTRegressor

    base = dict(featuresCol="features", labelCol="target", predictionCol="pred", weightCol="weight", validationIndicatorCol="validates", maxDepth=4, maxIter=20, stepSize=0.1,
                subsamplingRate=1.0, featureSubsetStrategy="all", minInstancesPerNode=5, maxBins=64, validationTol=0.01, seed=42)
    return GBTRegressor(**{**base, **params})


@dataclass(frozen=True)
class FoldData:
    """What one fold's models are fitted on: a settled table (sample_id, fold, target, weight, validates, bins) and the order of its bins."""

    fold: int
    rows: DataFrame
    features: tuple[str, ...]


def fold_data(df: DataFrame, features: Sequence[str], edges: DataFrame, scales: DataFrame, folds: Sequence[int]) -> list[FoldData]:
    """Per fold every row with its features as bin numbers by the edges of the fold's training rows (as many edges as are at most the value; one number
    more where the value is missing), and its weight by their scale. edges: (val_fold, factor, edges), scales: (val_fold, tau); both have a few rows
    per fold and column, and are what comes to the driver. Binned once, a table serves every fit of its fold."""
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    found = {(r["val_fold"], r["factor"]): list(r["edges"]) for r in edges.collect()}
    tau = {r["val_fold"]: r["tau"] for r in scales.collect()}
    missing = F.lit(float("nan"))
    typed = df.select(*[F.coalesce(F.col(c).cast("double"), missing).alias(c) for c in features], "sample_id", "fold", "target")
    out = []
    for k in folds:
        splits = [[-math.inf, *found.get((k, c), [0.0, 0.0])[1:], math.inf] for c in features]
        bins = Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[f"b_{c}" for c in features], handleInvalid="keep")
        vector = VectorAssembler(inputCols=[f"b_{c}" for c in features], outputCol="bins")
        rows = vector.transform(bins.transform(typed)).select(
            "sample_id", "fold", "target", (F.col("fold") == k).alias("validates"), sample_weight("target", F.lit(float(tau[k]))).alias("weight"),
            F.col("bins").alias("bins", metadata={}),  # ordered numbers, not categories
        )
        out.append(FoldData(k, settle(rows), tuple(features)))
    return out


def fit_folds(data: Sequence[FoldData], features: Sequence[str] | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, importances): one model per fold, fitted on the other folds' rows and stopped early by its own, on all
    or some of the features. The loop is over models; each fit is a Spark job over the training rows."""
    from pyspark.ml.feature import VectorSlicer

    parts, gains = [], []
    for d in data:
        kept = [c for c in d.features if features is None or c in set(features)]
        some = VectorSlicer(inputCol="bins", outputCol="features", indices=[d.features.index(c) for c in kept]).transform(d.rows)
        model = boosted_trees(**params).fit(some)
        parts.append(model.transform(some.where("validates")).select("sample_id", "fold", "target", "pred"))
        gains += [(d.fold, c, float(g)) for c, g in zip(kept, model.featureImportances.toArray())]
    oof = reduce(DataFrame.unionByName, parts)
    return oof, oof.sparkSession.createDataFrame(gains, "fold int, feature string, gain double")


def mean_gain(importances: DataFrame) -> DataFrame:
    """(feature, gain): per-fold gains normalised to 1 and averaged."""
    share = div("gain", F.sum("gain").over(Window.partitionBy("fold")))
    return importances.withColumn("g", share).groupBy("feature").agg(F.avg("g").alias("gain"))


def top_k(gains: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """The k features with the highest gain in canonical order. `order` is (feature, ordinal)."""
    best = gains.orderBy(F.desc("gain"), F.asc("feature")).limit(k)
    return best.join(order, "feature").orderBy("ordinal")


def top_k_curve(data: Sequence[FoldData], gains: DataFrame, order: DataFrame, ks: Sequence[int], **params) -> DataFrame:
    """(k, mean, std): out-of-fold cosine of models refitted on the k best features, all from the same binned tables. The feature list and two
    numbers a model come to the driver."""
    spark, rows = gains.sparkSession, []
    for k in ks:
        oof, _ = fit_folds(data, [r.feature for r in top_k(gains, order, k).collect()], **params)
        s = oof_summary(fold_scores(oof)).first()
        rows.append((k, s["mean"], s["std"]))
    return spark.createDataFrame(rows, "k int, mean double, std double")
