"""Diagnostics of predictions against targets, and horizon scans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import bias_corrected_kurtosis, bias_corrected_skew, cosine, pearson
from ..functions.scalars import div
from .ordered import DEFAULT_LIMIT, Hot
from .quantiles import bin_of, cells, cut_points, quantiles, with_ranks
from .regression import design, fitted, solve_normal

# fixed values: strata of |target|
STRATA = (0.0, 1e-4, 1e-3, 3e-3, 1e-2, float("inf"))
ALL = "_all"


def as_one_group(df: DataFrame) -> DataFrame:
    return df.withColumn(ALL, F.lit(0))


def with_bin(df: DataFrame, value: str, bins: int, out: str, *, hot: Hot | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Equal-frequency bin 0..bins-1 of a column over the whole table."""
    cuts = cut_points(as_one_group(df.select(value)), value, bins, keys=[ALL], hot=hot, limit=limit).select("cuts")
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, bin_of(value)).drop("cuts")


def spearman(df: DataFrame, a: str, b: str, *, hot: Hot | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One row (rho); 0 where a side is constant."""
    ranked = with_ranks(as_one_group(df.select(a, b)), [ALL], {"_ra": (a, False), "_rb": (b, False)}, hot=hot, limit=limit)
    return ranked.agg(F.coalesce(pearson("_ra", "_rb", 0), F.lit(0.0)).alias("rho"))


def rescaled_cosine(df: DataFrame, p: str, y: str, key: str) -> DataFrame:
    """(cos, rescaled, gain): cosine as it is, and the best reachable when every group of `key` gets its
    own multiple."""
    p, y = F.col(p), F.col(y)
    g = df.groupBy(key).agg(F.sum(p * y).alias("A"), F.sum(p * p).alias("B"), F.sum(y * y).alias("Y"))
    return g.agg(
        div(F.sum("A"), F.sqrt(F.sum("B") * F.sum("Y"))).alias("cos"),
        div(F.sqrt(F.sum(F.when(F.col("B") > 0, F.col("A") * F.col("A") / F.col("B")))), F.sqrt(F.sum("Y"))).alias("rescaled"),
    ).withColumn("gain", F.col("rescaled") - F.col("cos"))


def group_multiples(df: DataFrame, p: str, y: str, key: str) -> DataFrame:
    g = df.groupBy(key).agg(F.sum(F.col(p) * F.col(y)).alias("A"), F.sum(F.col(p) * F.col(p)).alias("B"))
    return g.select(key, F.coalesce(div("A", "B"), F.lit(0.0)).alias("multiple"))


def target_strata(df: DataFrame, p: str = "pred", y: str = "target", edges: Sequence[float] = STRATA) -> DataFrame:
    """(stratum, share, py_share, p2_share, mean_abs_p, hit_rate) by |target|, plus the row 'zero'.
    The strata are made of one small grouped table, so every row is read once."""
    P, Y = F.col(p), F.col(y)
    label = reduce(
        lambda acc, i: acc.when((F.abs(Y) >= edges[i]) & (F.abs(Y) < edges[i + 1]), i), range(len(edges) - 1), F.when(F.lit(False), -1)
    )
    cells = df.groupBy(label.alias("i"), (Y == 0).alias("z")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(P * Y).alias("py"), F.sum(P * P).alias("pp"), F.sum(F.abs(P)).alias("ap"),
        F.count_if(P * Y > 0).alias("hit"),
    )
    tot = F.broadcast(cells.agg(F.sum("n").alias("tn"), F.sum("py").alias("tpy"), F.sum("pp").alias("tpp")))
    both = F.explode(F.array_compact(F.array(F.concat(F.lit("band "), F.col("i")), F.when(F.col("z"), F.lit("zero")))))
    rows = cells.withColumn("stratum", both).groupBy("stratum").agg(
        *[F.sum(c).alias(c) for c in ("n", "py", "pp", "ap", "hit")], F.sum(F.when(~F.col("z"), F.col("n"))).alias("nz")
    )
    return rows.crossJoin(tot).select(
        "stratum", div("n", "tn").alias("share"), div("py", "tpy").alias("py_share"), div("pp", "tpp").alias("p2_share"),
        div("ap", "n").alias("mean_abs_p"), div("hit", "nz").alias("hit_rate"),
    )


def zeroing_gain(df: DataFrame, p: str = "pred", y: str = "target") -> DataFrame:
    """(cos, zeroed): cosine, and cosine when predictions on zero targets are set to 0."""
    z = F.when(F.col(y) == 0, F.lit(0.0)).otherwise(F.col(p))
    return df.agg(cosine(p, y).alias("cos"), cosine(z, y).alias("zeroed"))


def zero_share_by_bin(df: DataFrame, value: str, bins: int, *, y="target", hot: Hot | None, limit=DEFAULT_LIMIT) -> DataFrame:
    d = with_bin(df, value, bins, "bin", hot=hot, limit=limit)
    return d.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), F.avg((F.col(y) == 0).cast("double")).alias("zero_share")
    )


def zero_shares(df: DataFrame, candidates: Sequence[str], bins: int, *, y="target", hot: Hot | None, limit=DEFAULT_LIMIT) -> DataFrame:
    """(candidate, bin, rows, mean, zero_share) over equal-frequency bins of every candidate, missing values left out. All cut points come
    from one pass and all bins from one more; the plan has one join, whatever the number of candidates."""
    specs = {f"_q{i}_{j}": (c, j / bins, "linear") for i, c in enumerate(candidates) for j in range(1, bins)}
    wide = quantiles(as_one_group(df), [ALL], specs, hot=hot, limit=limit)
    cuts = F.array(*[F.struct(F.lit(i).alias("_c"), F.lit(c).alias("candidate"), F.array(*[f"_q{i}_{j}" for j in range(1, bins)]).alias("cuts")) for i, c in enumerate(candidates)])
    long = cells(df.where(F.col(y).isNotNull()), candidates, [y])
    # a row per candidate
    binned = long.join(F.broadcast(wide.select(F.explode(cuts).alias("x")).select("x.*")), "_c").withColumn("bin", bin_of("_v"))
    return binned.groupBy("candidate", "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_v").alias("mean"), F.avg((F.col(y) == 0).cast("double")).alias("zero_share")
    )


def cause_table(df: DataFrame, candidates: Sequence[str], *, p="pred", y="target", hot: Hot | None, limit=DEFAULT_LIMIT) -> DataFrame:
    """(candidate, auc of a zero target, rho with |target|, rho with |prediction|), missing candidate values
    at their median. All ranks come from one pass, and the AUC from the ranks; rows without a target take no part."""
    df = df.where(F.col(y).isNotNull())
    medians = quantiles(as_one_group(df), [ALL], {f"_q_{c}": (c, 0.5, "linear") for c in candidates}, hot=hot, limit=limit)
    df = df.crossJoin(F.broadcast(medians.drop(ALL)))
    df = df.select(
        *[F.col(c) for c in df.columns if c not in candidates and not c.startswith("_q_")],
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_q_{c}")).alias(c) for c in candidates],
    )
    base = as_one_group(df).withColumn("_ay", F.abs(y)).withColumn("_ap", F.abs(p)).withColumn("_z", F.col(y) == 0)
    specs = {"_ry": ("_ay", False), "_rp": ("_ap", False), **{f"_r{i}": (c, False) for i, c in enumerate(candidates)}}
    ranked = with_ranks(base, [ALL], specs, hot=hot, limit=limit)
    zeros, others = F.count_if("_z").cast("double"), F.count_if(~F.col("_z"))

    def one(i: int, c: str) -> Column:
        wins = F.sum(F.when(F.col("_z"), F.col(f"_r{i}"))) - zeros * (zeros + 1) / F.lit(2.0)
        rho = lambda other: F.coalesce(pearson(f"_r{i}", other, 0), F.lit(0.0))
        return F.struct(F.lit(c).alias("candidate"), div(wins, zeros * others).alias("auc"), rho("_ry").alias("rho_target"), rho("_rp").alias("rho_pred")).alias(f"_s{i}")

    wide = ranked.groupBy(ALL).agg(*[one(i, c) for i, c in enumerate(candidates)])
    return wide.select(F.explode(F.array(*[f"_s{i}" for i in range(len(candidates))])).alias("_s")).select("_s.*")


def out_of_fold_linear(df: DataFrame, xs: Sequence[str], y: str, fold: str, *, out: str = "score") -> DataFrame:
    """Linear score of standardised columns (null as 0), each row scored by the fit on the other folds.
    The moments of 'all others' are the total minus the fold's own, so rows are read once per pass."""
    mom = df.agg(*[F.avg(F.coalesce(F.col(x), F.lit(0.0))).alias(f"m_{x}") for x in xs],
                 *[F.stddev_pop(F.coalesce(F.col(x), F.lit(0.0))).alias(f"s_{x}") for x in xs])
    z = df.crossJoin(F.broadcast(mom))
    for x in xs:
        sd = F.when(F.col(f"s_{x}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{x}"))
        z = z.withColumn(f"z_{x}", (F.coalesce(F.col(x), F.lit(0.0)) - F.col(f"m_{x}")) / sd).drop(f"m_{x}", f"s_{x}")
    zs = [f"z_{x}" for x in xs]
    coef = complement_least_squares(z, zs, y, fold)
    return z.join(F.broadcast(coef), fold).withColumn(out, fitted(zs, True)).drop("coef", *zs)


def complement_least_squares(df: DataFrame, xs: Sequence[str], y: str, fold: str) -> DataFrame:
    """(fold, coef): least squares with intercept over the rows of all other folds."""
    cols = design(xs, True)
    p = len(cols)
    names = [f"g{i}_{j}" for i in range(p) for j in range(i, p)] + [f"b{i}" for i in range(p)]
    exprs = [cols[i] * cols[j] for i in range(p) for j in range(i, p)] + [c * F.col(y).cast("double") for c in cols]
    own = df.groupBy(fold).agg(*[F.sum(e).alias(n) for n, e in zip(names, exprs)])
    tot = own.agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    rest = own.crossJoin(F.broadcast(tot)).select(fold, *[(F.col(f"t_{n}") - F.col(n)).alias(n) for n in names])
    gram = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    return rest.select(fold, solve_normal(gram, F.array(*[F.col(f"b{i}") for i in range(p)])).alias("coef"))


def fold_comparison(df: DataFrame, a: str, b: str, fold: str, y: str = "target") -> DataFrame:
    """(fold, cos_a, cos_b, delta) for two prediction columns."""
    return df.groupBy(fold).agg(cosine(a, y).alias("cos_a"), cosine(b, y).alias("cos_b")).withColumn(
        "delta", F.col("cos_b") - F.col("cos_a")
    )


def comparison_summary(df: DataFrame, a: str, b: str, fold: str, y: str = "target") -> DataFrame:
    """One row: mean and spread of the per-fold delta, folds improved, overall cosines, correlation."""
    per = fold_comparison(df, a, b, fold, y)
    folds = per.agg(
        F.avg("delta").alias("delta_mean"), F.stddev_pop("delta").alias("delta_std"),
        F.count_if(F.col("delta") > 0).alias("improved"), F.count(F.lit(1)).alias("folds"),
    )
    whole = df.agg(cosine(a, y).alias("cos_a"), cosine(b, y).alias("cos_b"), pearson(a, b, 2).alias("corr"))
    return folds.crossJoin(F.broadcast(whole))


def slice_comparison(df: DataFrame, a: str, b: str, key: str, y: str = "target", min_rows: int = 100) -> DataFrame:
    """(key, n, cos_a, cos_b, delta) inside slices with at least `min_rows` rows."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), cosine(a, y).alias("cos_a"), cosine(b, y).alias("cos_b"))
    return per.where(F.col("n") >= min_rows).withColumn("delta", F.col("cos_b") - F.col("cos_a"))


def amplitude_layers(df: DataFrame, p: str, y: str, band: str) -> DataFrame:
    """One row: cosine of the prediction, of sign x band RMS, of prediction / band RMS, and of the sign.
    Band RMS is joined back from the per-band sums (as many rows as bands)."""
    rms = df.groupBy(band).agg(F.sqrt(F.avg(F.col(p) * F.col(p))).alias("_rms"))
    d = df.join(F.broadcast(rms), band)
    s, safe = F.signum(p), F.when(F.col("_rms") == 0, F.lit(1.0)).otherwise(F.col("_rms"))
    return d.agg(
        cosine(p, y).alias("full"), cosine(s * F.col("_rms"), F.col(y)).alias("sign_and_profile"),
        cosine(F.col(p) / safe, F.col(y)).alias("sign_and_inside"), cosine(s, F.col(y)).alias("sign_only"),
    )


def band_profile(df: DataFrame, value: str, band: str) -> DataFrame:
    """(band, share, entropy): share of each band in the sum of band norms, and the entropy of the shares."""
    norms = df.groupBy(band).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("u"))
    tot = norms.agg(F.sum("u").alias("t"))
    u = div("u", "t")
    shares = norms.crossJoin(F.broadcast(tot)).select(band, u.alias("share"))
    ent = shares.agg((-F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share")))).alias("entropy"))
    return shares.crossJoin(F.broadcast(ent))


def identify(oof: DataFrame, registry: DataFrame, *, y="target", tolerance: float = 5e-5) -> DataFrame:
    """(arm, mean_cos, known, expected, match): per-fold mean cosine of each arm against a registry
    (arm, known, expected)."""
    per = oof.groupBy("arm", "fold").agg(cosine("pred", y).alias("c")).groupBy("arm").agg(F.avg("c").alias("mean_cos"))
    return per.join(F.broadcast(registry), "arm", "left").withColumn(
        "match", F.coalesce(F.abs(F.col("mean_cos") - F.col("expected")) < tolerance, F.lit(False))
    )


def pad_mass(valid: DataFrame, block: str, ok: str, weights: DataFrame) -> DataFrame:
    """Sum over blocks of weight x share of episodes in which the block is invalid."""
    share = valid.groupBy(block).agg(F.avg((~F.col(ok)).cast("double")).alias("_bad"))
    return share.join(F.broadcast(weights), block).agg(F.sum(F.col("weight") * F.col("_bad")).alias("pad_mass"))


# ---- horizons -----------------------------------------------------------------------------------


def horizon_spread(changes: DataFrame, value: str = "change", *, keys: Sequence[str] = ("h",)) -> DataFrame:
    """(keys, n, std, zero_share) of a change column; std is the population one."""
    return changes.groupBy(*keys).agg(
        F.count(value).alias("n"), F.stddev_pop(value).alias("std"), F.avg((F.col(value) == 0).cast("double")).alias("zero_share")
    )


def shape(df: DataFrame, value: str, *, hot: Hot | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Bias-corrected kurtosis and skew, and q99 / q99.9 of |value| over the whole table."""
    d = as_one_group(df.select(value).where(F.col(value).isNotNull())).withColumn("_abs", F.abs(value))
    q = quantiles(d, [ALL], {"q99": ("_abs", 0.99, "linear"), "q999": ("_abs", 0.999, "linear")}, hot=hot, limit=limit)
    m = d.groupBy(ALL).agg(bias_corrected_kurtosis(value).alias("kurt"), bias_corrected_skew(value).alias("skew"))
    return m.join(q, ALL).drop(ALL)
