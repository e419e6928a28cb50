"""Screening, composites, diagnostics, horizons."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.aggregates import cosine
from ..functions.scalars import round6_all
from ..operators import diagnostics as D, joins as J, regression as R, screening as S
from ..operators.ordered import newest_rows
from ..operators.quantiles import auc as auc_of, with_ranks
from ..plans import book, cross, names
from ..sources.adapters import Episodes
from ..sources.shared import scratch_path, settle
from ..sources.tables import write_predictions
from .factor_checks import BASE_BOOK, BASE_ORDER, BASE_TRADE, CATALOGUE, catalogue_sql, full_catalogue
from .registry import check

MIN = 20  # periods of the small tables have about 60 episodes

T = ["t_imb_2s", "t_imb_w10", "t_imb", "t_vol", "t_n", "last_gap"]
O = ["ofi_w10_norm", "patience_diff", "ofi_norm"]
B = ["spread0", "mid_vol60", "range_pos", "vol_skew"]
FX = [*T, *O, *B]
FACTORS = f"""ft as (select sample_id, {", ".join(f"r6({BASE_TRADE[c]}) as {c}" for c in T)} from tr group by 1),
    fo as (select sample_id, {", ".join(f"r6({BASE_ORDER[c]}) as {c}" for c in O)} from orr group by 1),
    fb as (select sample_id, {", ".join(f"r6({BASE_BOOK[c]}) as {c}" for c in B)} from bk group by 1),
    fx as (select label.sample_id, month, month % 6 as fold, r6(target) as target, {", ".join(FX)} from label join fb using (sample_id)
      left join ft using (sample_id) left join fo using (sample_id))"""
FV = "tr orr bk label"


def fx(e: Episodes, cols=tuple(FX)):
    """Rounded factors and targets: ranks and bins must see the same ties in every engine."""
    df = cross.catalogue(e.market, e.order, e.trade, list(cols))
    df = df.select("sample_id", *[F.col(c).cast("double") for c in cols])
    lab = e.label.select("sample_id", "month", (F.col("month") % 6).alias("fold"), "target")
    return round6_all(lab.join(df, "sample_id"))


# all 196 factors with label, in SQL and as one settled table
ALL_FACTORS = (
    f"{CATALOGUE}, fa as ({catalogue_sql(names.ALL)}), fx as materialized (select label.sample_id, month, month % 6 as fold, r6(target) as target, "
    + ", ".join(f"cast({c} as double) as {c}" for c in names.ALL)
    + " from label join fa using (sample_id)), lx as materialized (unpivot (select * from fx) on " + ", ".join(names.ALL) + " into name factor value x)"
)
AV = "tr orr bk months label"


@lru_cache(maxsize=4)
def all_factors(e: Episodes):
    """Rounded factors and targets of the whole catalogue, settled once for all queries that read them."""
    df = full_catalogue(e).select("sample_id", *[F.col(c).cast("double") for c in names.ALL])
    lab = e.label.select("sample_id", "month", (F.col("month") % 6).alias("fold"), "target")
    return settle(round6_all(lab.join(df, "sample_id")))


PR = """pr as (select sample_id, month, month % 6 as fold, floor(target*1e3+0.4871e0)/1e3 as target, r6(p_a) as p_a, p_b, r6(p_c) as p_c from pred)"""


def pr(e: Episodes):
    """Members and a target of three decimals, which has zeros and ties."""
    coarse = F.floor(F.col("target") * F.lit(1e3) + F.lit(0.4871)) / F.lit(1e3)
    return round6_all(e.predictions.withColumn("fold", F.col("month") % 6).withColumn("target", coarse), "target")


def sql_corr(x: str, y: str, n: int = MIN, cond: str = "true") -> str:
    both = f"({x}) is not null and ({y}) is not null and {cond}"
    return f"case when fcnt({both})>={n} and var_pop({x}) filter (where {both})>0 and var_pop({y}) filter (where {both})>0 then corr({x},{y}) filter (where {cond}) end"


def sql_cos(x: str, y: str = "target", n: int = MIN) -> str:
    return f"case when fcnt(({x}) is not null and ({y}) is not null)>{n} then cosine({x},{y}) end"


ALL_LONG = ALL_FACTORS + ", ln as materialized (select * from fx unpivot include nulls (x for factor in (" + ", ".join(names.ALL) + ")))"
SCORES = f"""sc as (select month, factor, {sql_corr('x', 'target')} as corr, {sql_corr('x', 'sign(target)')} as corr_sign, {sql_corr('x', 'abs(target)')} as corr_abs, {sql_cos('x')} as cos
    from ln group by month, factor)"""
SCREEN = """sm as (select factor, avg(corr) as corr_mean, stddev_pop(corr) as corr_std, avg(case when corr>0 then 1e0 else 0e0 end) as pos_frac,
    avg(cos) as cos_mean, stddev_pop(cos) as cos_std, avg(corr_sign) as corr_sign_mean, avg(corr_abs) as corr_abs_mean from sc group by factor)"""
SUMS = ("corr_mean", "corr_std", "pos_frac", "cos_mean", "cos_std", "corr_sign_mean", "corr_abs_mean")
ROUNDED = ", ".join(f"r6({c}) as {c}" for c in SUMS)


def all_scores(e: Episodes):
    return S.period_scores(all_factors(e), names.ALL, min_rows=MIN)


@check("e1_period_scores", views=AV, ctes=f"{ALL_LONG}, {SCORES}",
       select="select month, factor, r6(corr) as corr, r6(corr_sign) as corr_sign, r6(corr_abs) as corr_abs, r6(cos) as cos from sc")
def period_scores(e: Episodes):
    return round6_all(all_scores(e))


@check("e1_screen", views=AV, ctes=f"{ALL_LONG}, {SCORES}, {SCREEN}", select=f"select factor, {ROUNDED} from sm")
def screen(e: Episodes):
    return round6_all(S.screen(all_scores(e)))


@check("s3_top_factors", views=AV, ctes=f"{ALL_LONG}, {SCORES}, {SCREEN}, rr as (select factor, {ROUNDED} from sm)",
       select="select * from rr order by cos_mean desc nulls last, factor limit 5")
def top_factors(e: Episodes):
    return S.top_factors(round6_all(S.screen(all_scores(e))), "cos_mean", 5)


ANCHORS = ["t_imb", "ofi_norm", "spread0", "mid_vol60", "t_vol", "t_n"]
TESTED = ["t_imb_w10", "t_imb_2s", "ofi_w10_norm", "patience_diff", "range_pos"]


@check("e2_redundancy", views=FV,
       ctes=FACTORS + ", rc as (" + " union all ".join(f"select '{f}' as a, '{a}' as b, {sql_corr(f, a, 100)} as corr from fx" for f in TESTED for a in ANCHORS) + ")",
       select="select a, b, r6(corr) as corr from rc where abs(corr) > 0.3")
def redundancy(e: Episodes):
    return round6_all(S.redundant(fx(e), TESTED, ANCHORS, above=0.3))


@check("e3_period_stability", views=AV,
       ctes=ALL_LONG + ", c as (select month, factor, cosine(x,target) as cos from ln group by month, factor)",
       select="""select factor, r6(avg(cos)) as cos_mean, r6(stddev_pop(cos)) as cos_std, r6(avg(case when cos>0 then 1e0 else 0e0 end)) as pos_frac,
         fcnt(cos<0) as neg_periods from c where cos is not null group by factor""")
def stability(e: Episodes):
    return round6_all(S.period_stability(all_factors(e), names.ALL))


@check("e4_residual_cosine", views=FV,
       ctes=FACTORS + """, ok as (select * from fx where t_imb is not null and ofi_norm is not null and range_pos is not null and t_n is not null),
         k as (select regr_slope(t_imb, t_n) as b1, regr_intercept(t_imb, t_n) as a1, regr_slope(ofi_norm, t_n) as b2, regr_intercept(ofi_norm, t_n) as a2,
           regr_slope(range_pos, t_n) as b3, regr_intercept(range_pos, t_n) as a3 from ok),
         r as (select target, t_imb-a1-b1*t_n as r1, ofi_norm-a2-b2*t_n as r2, range_pos-a3-b3*t_n as r3 from ok cross join k)""",
       select="""select 't_imb' as factor, r6(cosine(r1,target)) as cos from r union all select 'ofi_norm', r6(cosine(r2,target)) from r
         union all select 'range_pos', r6(cosine(r3,target)) from r""")
def residual_cosine(e: Episodes):
    return round6_all(R.residual_cosine(fx(e), ["t_imb", "ofi_norm", "range_pos"], ["t_n"], "target"))


@check("e5_keep_or_drop", views=FV,
       ctes=FACTORS + ", c as (" + " union all ".join(f"select month, '{f}' as factor, cosine({f},target) as cos from fx group by month" for f in FX) + "),"
       " g as (" + " union all ".join(f"select '{f}' as factor, cosine({f},target) as cos_full, cosine({f}*{f},target) as cos_last from fx" for f in FX) + "),"
       " p as (select factor, avg(case when cos>0 then 1e0 else 0e0 end) as pos_frac from c where cos is not null group by 1)",
       select="""select factor, case when greatest(abs(cos_last),abs(cos_full))<0.02 and (pos_frac is null or pos_frac<0.55) then 'drop'
         when greatest(abs(cos_last),abs(cos_full))<0.05 then 'weak' else 'keep' end as verdict from g join p using (factor)""")
def keep_or_drop(e: Episodes):
    df = fx(e)
    wide = df.agg(*[F.struct(F.lit(f).alias("factor"), cosine(f, "target").alias("cos_full"), cosine(F.col(f) * F.col(f), F.col("target")).alias("cos_last")).alias(f) for f in FX])
    scores = wide.select(F.explode(F.array(*FX)).alias("r")).select("r.*")
    return S.keep_or_drop(scores.join(S.period_stability(df, FX), "factor"), dead=0.02).select("factor", "verdict")


# ---- ranks and composites -----------------------------------------------------------------------

DIR = {"t_imb_2s": 0.2, "t_imb_w10": 0.3, "ofi_w10_norm": 0.2, "patience_diff": 0.1}


def rank_sql(c: str, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    ties = f"partition by {by + ', ' if by else ''}{c}"
    n = f"count({c}) over ({part})"
    r = f"(rank() over ({part} order by {c} nulls last) + (count({c}) over ({ties})-1)/2e0)"
    return f"case when {c} is not null then {r} end", f"case when {c} is not null then 2*({r}-1)/nullif({n}-1e0,0e0)-1 end"


RANKS = "rk as (select *, " + ", ".join(f"{rank_sql(c)[1]} as r_{c}" for c in [*DIR, "t_vol", "t_n", "last_gap"]) + " from fx)"


def mean_of(cols) -> str:
    return "div(" + "+".join(f"coalesce({c},0e0)" for c in cols) + ", " + "+".join(f"({c} is not null)::int" for c in cols) + ")"


def ranked(e: Episodes, cols):
    return S.rank_columns(D.as_one_group(fx(e)), cols, keys=["_all"], hot=e.hot_all, limit=e.limit)


@check("w12_rank_global", views=FV, ctes=FACTORS,
       select=f"select sample_id, r6({rank_sql('t_imb_2s')[0]}) as r_t_imb_2s, r6({rank_sql('patience_diff')[1]}) as n_patience_diff from fx")
def rank_global(e: Episodes):
    df = D.as_one_group(fx(e))
    df = with_ranks(df, ["_all"], {"r_t_imb_2s": ("t_imb_2s", False), "n_patience_diff": ("patience_diff", True)}, hot=e.hot_all, limit=e.limit)
    return round6_all(df.select("sample_id", "r_t_imb_2s", "n_patience_diff"))


@check("w12_rank_by_period", views=FV, ctes=FACTORS,
       select=f"select sample_id, r6({rank_sql('t_imb_2s', 'month')[0]}) as r_t_imb_2s, r6({rank_sql('ofi_norm', 'month')[1]}) as n_ofi_norm from fx")
def rank_by_period(e: Episodes):
    df = with_ranks(fx(e), ["month"], {"r_t_imb_2s": ("t_imb_2s", False), "n_ofi_norm": ("ofi_norm", True)}, hot=e.hot_months, limit=e.limit)
    return round6_all(df.select("sample_id", "r_t_imb_2s", "n_ofi_norm"))


@check("e6_composites", views=FV, ctes=f"{FACTORS}, {RANKS}",
       select="select sample_id, r6(" + mean_of([f"r_{c}" for c in DIR]) + ") as rank_mean, r6(" + mean_of([f"sign(r_{c})" for c in DIR]).replace("(sign(", "(sign(") + ") as vote, "
       "r6(div(" + "+".join(f"{w}e0*coalesce(r_{c},0e0)" for c, w in DIR.items()) + ", " + "+".join(f"case when r_{c} is not null then {w}e0 else 0e0 end" for c, w in DIR.items()) + ")) as weighted from rk")
def composites(e: Episodes):
    df = ranked(e, list(DIR))
    cols = [F.col(f"r_{c}") for c in DIR]
    return round6_all(
        df.select("sample_id", S.row_mean(cols).alias("rank_mean"), S.sign_vote(cols).alias("vote"), S.weighted_mean({f"r_{c}": w for c, w in DIR.items()}).alias("weighted"))
    )


KS = [0.25, 0.35, 0.5, 0.65, 0.8, 1.0]
COMBO = mean_of(["r_t_imb_2s", "r_t_imb_w10", "r_ofi_w10_norm"])
SIGMA = mean_of(["r_t_vol", "r_t_n", "(-r_last_gap)"])


@check("e7_modulation", views=FV,
       ctes=f"{FACTORS}, {RANKS}, m as (select month, target, {COMBO} as combo, {SIGMA} as sigma, {rank_sql('abs(target)')[1]} as amp from rk), c as ("
       + " union all ".join(f"select month, {k}e0 as k, {sql_cos(f'combo*(1+{k}e0*sigma)')} as cos from m group by month" for k in KS)
       + f" union all select month, null as k, {sql_cos('combo*amp')} as cos from m group by month)",
       select="select k, r6(avg(cos)) as cos_mean, r6(min(cos)) as cos_min, fcnt(cos<0) as neg from c group by k")
def modulation(e: Episodes):
    rows = fx(e).withColumn("amp", F.abs("target"))
    df = S.rank_columns(D.as_one_group(rows), ["t_imb_2s", "t_imb_w10", "ofi_w10_norm", "t_vol", "t_n", "last_gap", "amp"], keys=["_all"], hot=e.hot_all, limit=e.limit)
    df = df.select("month", "target", "r_amp", S.row_mean([F.col(f"r_{c}") for c in ("t_imb_2s", "t_imb_w10", "ofi_w10_norm")]).alias("combo"),
                   S.row_mean([F.col("r_t_vol"), F.col("r_t_n"), -F.col("r_last_gap")]).alias("sigma"))
    return round6_all(S.modulation_grid(df, "combo", "sigma", KS, bound="r_amp", min_rows=MIN), "k")


@check("io7_formula_submission", views=FV, ctes=f"{FACTORS}, {RANKS}",
       select="select sample_id, r6(coalesce(div(" + "+".join(f"{w}e0*coalesce(r_{c},0e0)" for c, w in DIR.items()) + ", " + "+".join(f"case when r_{c} is not null then {w}e0 else 0e0 end" for c, w in DIR.items())
       + "), 0e0) * (1 + 0.5e0*r_t_vol)) as prediction from rk")
def formula(e: Episodes):
    df = ranked(e, [*DIR, "t_vol"])
    combo = F.coalesce(S.weighted_mean({f"r_{c}": w for c, w in DIR.items()}), F.lit(0.0))
    path = scratch_path(e.spark, "submission.parquet")
    write_predictions(df.select("sample_id", (combo * (1 + F.lit(0.5) * F.col("r_t_vol"))).alias("prediction")), path)
    return round6_all(e.spark.read.parquet(path))


OLS2 = """n as (select month, sum(a*a) as aa, sum(a*b) as ab, sum(b*b) as bb, sum(a*target) as ay, sum(b*target) as bt from rm where a is not null and b is not null group by month),
    wt as (select month, (ay*bb-bt*ab)/(aa*bb-ab*ab) as wa, (bt*aa-ay*ab)/(aa*bb-ab*ab) as wb from n)"""
RM = f"rm as (select month, target, t_n, {rank_sql('t_imb_w10', 'month')[0]} as a, {rank_sql('patience_diff', 'month')[0]} as b from fx)"


def rank_only(e: Episodes):
    return with_ranks(fx(e), ["month"], {"a": ("t_imb_w10", False), "b": ("patience_diff", False)}, hot=e.hot_months, limit=e.limit)


@check("a17_least_squares", views=FV, ctes=f"{FACTORS}, {RM}, {OLS2}",
       select="select month, r6(wa*1e3) as wa, r6(wb*1e3) as wb from wt")
def least_squares(e: Episodes):
    fit = R.least_squares(rank_only(e), ["a", "b"], "target", keys=["month"])
    return round6_all(fit.select("month", (F.col("coef")[0] * 1e3).alias("wa"), (F.col("coef")[1] * 1e3).alias("wb")))


@check("e8_weight_drift", views=FV,
       ctes=f"{FACTORS}, {RM}, {OLS2}, ac as (select month, avg(t_n) as act from rm group by 1), l as (select month, 'a' as factor, wa as w, wa/(wa+wb) as share from wt union all select month, 'b', wb, wb/(wa+wb) from wt), "
       "j as (select *, row_number() over (partition by factor order by month) as i, count(*) over (partition by factor) as n from l join ac using (month))",
       select="""select factor, r6(avg(share)) as mean, r6(stddev_pop(share)) as std, r6(min(share)) as min, r6(max(share)) as max, fcnt(w<0) as negative,
         r6(favg(share, i<=4)) as early, r6(favg(share, i>n-4)) as late, r6(corr(share, act)) as corr_activity from j group by factor""")
def weight_drift(e: Episodes):
    df = rank_only(e)
    w = S.period_weights(df, ["a", "b"])
    return round6_all(S.weight_drift(w, df.groupBy("month").agg(F.avg("t_n").alias("act")), edge=4))


# ---- predictions against targets ----------------------------------------------------------------

EDGES = (0.0, 1e-3, 5e-3, 1e-2, 3e-2, float("inf"))


@check("e10_target_strata", views="pred",
       ctes=PR + """, b as (select *, case when abs(target)<0.001 then 0 when abs(target)<0.005 then 1 when abs(target)<0.01 then 2 when abs(target)<0.03 then 3 else 4 end as i from pr),
         l as (select concat('band ', i) as stratum, * from b union all select 'zero', * from b where target=0), t as (select count(*) as tn, sum(p_b*target) as tpy, sum(p_b*p_b) as tpp from b)""",
       select="""select stratum, r6(count(*)/max(tn)) as share, r6(sum(p_b*target)/max(tpy)) as py_share, r6(sum(p_b*p_b)/max(tpp)) as p2_share, r6(avg(abs(p_b))) as mean_abs_p,
         r6(div(fcnt(p_b*target>0), nullif(fcnt(target<>0),0))) as hit_rate from l cross join t group by stratum""")
def strata(e: Episodes):
    return round6_all(D.target_strata(pr(e), "p_b", "target", EDGES))


@check("e10_zeroing_gain", views="pred", ctes=PR, select="select r6(cosine(p_b,target)) as cos, r6(cosine(case when target=0 then 0e0 else p_b end, target)) as zeroed from pr")
def zeroing(e: Episodes):
    return round6_all(D.zeroing_gain(pr(e), "p_b"))


def bins_sql(col: str, src: str, n: int, out: str = "bin") -> str:
    cuts = ", ".join(f"quantile_cont({col},{i}/{n}::double) as q{i}" for i in range(1, n))
    count = "+".join(f"(q{i}<{col})::int" for i in range(1, n))
    return f"(select *, {count} as {out} from {src} cross join (select {cuts} from {src}) cq)"


@check("w13_equal_frequency_bins", views="pred", ctes=PR,
       select=f"select sample_id, bin from {bins_sql('target', 'pr', 10)}")
def bins(e: Episodes):
    return D.with_bin(pr(e), "target", 10, "bin", hot=e.hot_all, limit=e.limit).select("sample_id", "bin")


@check("e10_zero_share_by_bin", views="pred", ctes=PR + ", z as (select *, abs(p_b) as ap from pr)",
       select=f"select bin, count(*) as rows, r6(avg(ap)) as mean, r6(avg(case when target=0 then 1e0 else 0e0 end)) as zero_share from {bins_sql('ap', 'z', 10)} group by bin")
def zero_share(e: Episodes):
    return round6_all(D.zero_share_by_bin(pr(e).withColumn("ap", F.abs("p_b")), "ap", 10, hot=e.hot_all, limit=e.limit))


def avg_rank(c: str) -> str:
    return f"(rank() over (order by {c}) + (count(*) over (partition by {c})-1)/2e0)"


AUC = "(sum(rv) filter (where z) - fcnt(z)*(fcnt(z)+1)/2e0)/nullif(fcnt(z)*cast(fcnt(not z) as double),0e0)"
CAND = ["p_a", "p_c", "fold"]


@check("a18_auc", views="pred", ctes=PR + f", r as (select target>0 as z, {avg_rank('p_b')} as rv from pr)", select=f"select r6({AUC}) as auc from r")
def auc(e: Episodes):
    df = D.as_one_group(pr(e)).withColumn("z", F.col("target") > 0)
    return round6_all(auc_of(df, "p_b", "z", hot=e.hot_all, limit=e.limit, keys=["_all"]).select("auc"))


@check("a19_spearman", views="pred", ctes=PR + f", r as (select {avg_rank('p_b')} as ra, {avg_rank('target')} as rb from pr)", select="select r6(corr(ra,rb)) as rho from r")
def spearman(e: Episodes):
    return round6_all(D.spearman(pr(e), "p_b", "target", hot=e.hot_all, limit=e.limit))


@check("e11_cause_table", views="pred",
       ctes=PR + ", s as (select *, abs(target) as ay, abs(p_b) as ap, month % 3 = 0 as zz from pr), " + ", ".join(
           f"c{i} as (select target=0 as z, {avg_rank(c)} as rv, {avg_rank('ay')} as ry, {avg_rank('ap')} as rp from s)" for i, c in enumerate(CAND)),
       select=" union all ".join(f"select '{c}' as candidate, r6({AUC}) as auc, r6(coalesce(corr(rv,ry),0)) as rho_target, r6(coalesce(corr(rv,rp),0)) as rho_pred from c{i}" for i, c in enumerate(CAND)))
def causes(e: Episodes):
    return round6_all(D.cause_table(pr(e), CAND, p="p_b", hot=e.hot_all, limit=e.limit))


@check("e11_zero_shares", views="pred", ctes=PR,
       select=" union all ".join(f"select '{c}' as candidate, bin, count(*) as rows, r6(avg({c})) as mean, r6(avg(case when target=0 then 1e0 else 0e0 end)) as zero_share from {bins_sql(c, 'pr', 10)} group by bin" for c in CAND))
def cause_bins(e: Episodes):
    return round6_all(D.zero_shares(pr(e), CAND, 10, hot=e.hot_all, limit=e.limit))


LINEAR = ["t_imb", "ofi_norm", "spread0", "t_n", "range_pos"]


def linear_sql() -> str:
    """Least squares with intercept on the other folds' rows: columns made orthogonal one after the other, each then by its own slope."""
    train = "filter (where fold<>vf)"
    steps = ["l0 as (select vf, fx.fold, sample_id, case when target>0 then 1e0 else 0e0 end as y, " + ", ".join(f"coalesce({c},0e0) as v{i}" for i, c in enumerate(LINEAR))
             + " from fx cross join (select unnest(range(0,6)) as vf) f)",
             "lm as (select *, avg(y) " + train + " over g as my, " + ", ".join(f"v{i} - avg(v{i}) {train} over g as w0_{i}" for i in range(len(LINEAR))) + " from l0 window g as (partition by vf))"]
    last = "lm"
    for j in range(len(LINEAR) - 1):
        rest = ", ".join(f"w{j}_{i} - coalesce(div(sum(w{j}_{i}*w{j}_{j}) {train} over g, sum(w{j}_{j}*w{j}_{j}) {train} over g),0e0)*w{j}_{j} as w{j + 1}_{i}" for i in range(j + 1, len(LINEAR)))
        steps.append(f"lg{j} as (select *, {rest} from {last} window g as (partition by vf))")
        last = f"lg{j}"
    fit = " + ".join(f"coalesce(div(sum(w{j}_{j}*y) {train} over g, sum(w{j}_{j}*w{j}_{j}) {train} over g),0e0)*w{j}_{j}" for j in range(len(LINEAR)))
    steps.append(f"ls as (select sample_id, y>0 as z, r6(score) as score from (select *, my + {fit} as score from {last} window g as (partition by vf)) where vf=fold)")
    return ", ".join(steps)


def linear_scores(e: Episodes):
    """Rounded out-of-fold scores of five factors, and whether the target is positive."""
    df = fx(e).withColumn("y", (F.col("target") > 0).cast("double"))
    found = D.out_of_fold_linear(df, LINEAR, "y", "fold")
    return round6_all(found.select("sample_id", (F.col("y") > 0).alias("z"), "score"))


@check("e12_linear_scores", views=FV, ctes=f"{FACTORS}, {linear_sql()}", select="select sample_id, score from ls")
def linear_columns(e: Episodes):
    return linear_scores(e).select("sample_id", "score")


@check("e12_linear_auc", views=FV, ctes=f"{FACTORS}, {linear_sql()}, r as (select z, {avg_rank('score')} as rv from ls)", select=f"select r6({AUC}) as auc from r")
def linear_auc(e: Episodes):
    """The AUC of the score of several columns, beside it in one pass over the rows."""
    return round6_all(auc_of(D.as_one_group(linear_scores(e)), "score", "z", hot=e.hot_all, limit=e.limit, keys=["_all"]).select("auc"))


@check("e12_out_of_fold_linear", views="pred",
       ctes=PR + """, st as (select avg(p_b) as m, stddev_pop(p_b) as sd from pr), zz as (select pr.*, (p_b-m)/sd as x, case when target>0 then 1e0 else 0e0 end as y from pr cross join st),
         cf as (select f.fold, regr_slope(y,x) as b, regr_intercept(y,x) as a from (select distinct fold from zz) f join zz on zz.fold<>f.fold group by 1)""",
       select="select sample_id, r6(a+b*x) as score from zz join cf using (fold)")
def oof_linear(e: Episodes):
    df = pr(e).withColumn("y", (F.col("target") > 0).cast("double"))
    return round6_all(D.out_of_fold_linear(df, ["p_b"], "y", "fold").select("sample_id", "score"))


@check("e13_rescale_gain", views="pred",
       ctes=PR + f", ora as (select *, abs(target) as ay from pr), g as (select 'month' as grouping, month as key, * from pr union all by name select 'p_c' as grouping, bin as key, * from {bins_sql('p_c', 'pr', 10)} union all by name select 'oracle' as grouping, bin as key, * from {bins_sql('ay', 'ora', 20)}), "
       "s as (select grouping, key, sum(p_b*target) as a, sum(p_b*p_b) as b, sum(target*target) as y from g group by 1,2)",
       select="select grouping, r6(sum(a)/sqrt(sum(b)*sum(y))) as cos, r6(sqrt(sum(a*a/b) filter (where b>0))/sqrt(sum(y))) as rescaled from s group by grouping")
def rescale(e: Episodes):
    df = pr(e)
    by_month = D.rescaled_cosine(df, "p_b", "target", "month").withColumn("grouping", F.lit("month"))
    by_bin = D.rescaled_cosine(D.with_bin(df, "p_c", 10, "key", hot=e.hot_all, limit=e.limit), "p_b", "target", "key").withColumn("grouping", F.lit("p_c"))
    ora = df.withColumn("ay", F.abs("target"))
    by_target = D.rescaled_cosine(D.with_bin(ora, "ay", 20, "key", hot=e.hot_all, limit=e.limit), "p_b", "target", "key").withColumn("grouping", F.lit("oracle"))
    return round6_all(by_month.unionByName(by_bin).unionByName(by_target).select("grouping", "cos", "rescaled"))


@check("a20_group_rescale", views="pred", ctes=PR, select="select month, r6(div(sum(p_b*target)*1e3, sum(p_b*p_b))) as multiple from pr group by month")
def multiples(e: Episodes):
    return round6_all(D.group_multiples(pr(e), "p_b", "target", "month").withColumn("multiple", F.col("multiple") * 1e3))


@check("e14_fold_comparison", views="pred", ctes=PR, select="select fold, r6(cosine(p_b,target)) as cos_a, r6(cosine(p_a,target)) as cos_b, r6(cosine(p_a,target)-cosine(p_b,target)) as delta from pr group by fold")
def fold_comparison(e: Episodes):
    return round6_all(D.fold_comparison(pr(e), "p_b", "p_a", "fold"))


@check("e14_comparison_summary", views="pred",
       ctes=PR + ", f as (select fold, cosine(p_a,target)-cosine(p_b,target) as delta from pr group by 1), w as (select cosine(p_b,target) as cos_a, cosine(p_a,target) as cos_b, corr(p_a,p_b) as corr from pr)",
       select="select r6(avg(delta)) as delta_mean, r6(stddev_pop(delta)) as delta_std, fcnt(delta>0) as improved, count(*) as folds, r6(max(cos_a)) as cos_a, r6(max(cos_b)) as cos_b, r6(max(corr)) as corr from f cross join w")
def comparison_summary(e: Episodes):
    return round6_all(D.comparison_summary(pr(e), "p_b", "p_a", "fold"))


@check("e14_slice_comparison", views="pred", ctes=PR + ", o as (select *, abs(target) as ay from pr)",
       select=f"select bin, count(*) as n, r6(cosine(p_b,target)) as cos_a, r6(cosine(p_a,target)) as cos_b, r6(cosine(p_a,target)-cosine(p_b,target)) as delta from {bins_sql('ay', 'o', 5)} group by bin having count(*)>=100")
def slices(e: Episodes):
    df = D.with_bin(pr(e).withColumn("ay", F.abs("target")), "ay", 5, "bin", hot=e.hot_all, limit=e.limit)
    return round6_all(D.slice_comparison(df, "p_b", "p_a", "bin"))


LAYER = PR + f", o as (select *, abs(target) as ay from pr), bb as (select *, sqrt(avg(p_b*p_b) over (partition by bin)) as rms from {bins_sql('ay', 'o', 10)})"


@check("e15_amplitude_layers", views="pred", ctes=LAYER,
       select="""select r6(cosine(p_b,target)) as "full", r6(cosine(sign(p_b)*rms,target)) as sign_and_profile,
         r6(cosine(p_b/case when rms=0 then 1e0 else rms end,target)) as sign_and_inside, r6(cosine(sign(p_b)*1e0,target)) as sign_only from bb""")
def layers(e: Episodes):
    df = D.with_bin(pr(e).withColumn("ay", F.abs("target")), "ay", 10, "bin", hot=e.hot_all, limit=e.limit)
    return round6_all(D.amplitude_layers(df, "p_b", "target", "bin"))


@check("e15_band_profile", views="pred",
       ctes=LAYER + ", n as (select bin, sqrt(sum(p_b*p_b)) as u from bb group by 1), s as (select bin, u/sum(u) over () as share from n)",
       select="select bin, r6(share) as share, r6((select -sum(share*ln(share)) from s where share>0)) as entropy from s")
def band_profile(e: Episodes):
    df = D.with_bin(pr(e).withColumn("ay", F.abs("target")), "ay", 10, "bin", hot=e.hot_all, limit=e.limit)
    return round6_all(D.band_profile(df, "p_b", "bin"))


@check("m5_entropy", views="pred",
       ctes=LAYER + ", n as (select bin, sqrt(sum(p_b*p_b)) as u from bb group by 1), s as (select bin, u/sum(u) over () as share from n)",
       select="select r6(-sum(share*ln(share))) as entropy from s where share>0")
def entropy(e: Episodes):
    return band_profile(e).select("entropy").distinct()


ARMS = PR + ", arms as (select 'a' as arm, fold, p_a as pred, target from pr union all select 'b', fold, p_b, target from pr union all select 'c', fold, p_c, target from pr)"


def arms(e: Episodes):
    df = pr(e)
    one = lambda a: df.select(F.lit(a).alias("arm"), "sample_id", "month", "fold", F.col(f"p_{a}").alias("pred"), "target")
    return one("a").unionByName(one("b")).unionByName(one("c"))


@check("e16_identify_arm", views="pred",
       ctes=ARMS + ", f as (select arm, fold, cosine(pred,target) as c from arms group by 1,2), m as (select arm, avg(c) as mean_cos from f group by 1), g as (select 'a' as arm, 'mean price' as known, 0.2e0 as expected union all select 'b', 'signed volume', 0.0214e0)",
       select="select arm, r6(mean_cos) as mean_cos, known, expected, coalesce(abs(mean_cos-expected)<5e-5, false) as \"match\" from m left join g using (arm)")
def identify(e: Episodes):
    registry = e.spark.createDataFrame([("a", "mean price", 0.2), ("b", "signed volume", 0.0214)], "arm string, known string, expected double")
    return round6_all(D.identify(arms(e), registry), "expected")


@check("e17_arm_correlation", views="pred",
       ctes=PR, select=" union all ".join(
           f"select '{w}' as rows, '{a}' as a, '{b}' as b, r6({sql_corr(a, b, 2, c)}) as corr from pr"
           for w, c in (("positive", "target>0"), ("negative", "target<=0")) for a, b in (("p_a", "p_b"), ("p_a", "p_c"), ("p_b", "p_c"))))
def arm_correlation(e: Episodes):
    pairs, df = [("p_a", "p_b"), ("p_a", "p_c"), ("p_b", "p_c")], pr(e)
    up = S.correlation_pairs(df, pairs, 2, F.col("target") > 0).select(F.lit("positive").alias("rows"), "*")
    down = S.correlation_pairs(df, pairs, 2, F.col("target") <= 0).select(F.lit("negative").alias("rows"), "*")
    return round6_all(up.unionByName(down))


@check("a16_correlation_matrix", views="pred", ctes=PR,
       select=" union all ".join(f"select '{a}' as a, '{b}' as b, r6(corr({a},{b})) as corr from pr" for a, b in (("p_a", "p_b"), ("p_a", "p_c"), ("p_b", "p_c"))))
def correlation_matrix(e: Episodes):
    return round6_all(S.correlation_matrix(pr(e), ["p_a", "p_b", "p_c"]))


@check("e18_pad_mass", views="market",
       ctes="n as (select sample_id, count(*) as n from market group by 1), b as (select sample_id, n, unnest(range(0,14)) as block from n), w as (select block, avg(case when n > block*16 then 0e0 else 1e0 end) as bad from b group by 1)",
       select="select r6(sum(bad*(block+1)/105e0)) as pad_mass from w")
def pad_mass(e: Episodes):
    n = e.market.df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("block")).withColumn("ok", F.col("n") > F.col("block") * 16)
    weights = blocks.select("block").distinct().withColumn("weight", (F.col("block") + 1) / F.lit(105.0))
    return round6_all(D.pad_mass(blocks, "block", "ok", weights))


# ---- horizons -----------------------------------------------------------------------------------

HS = [3.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0]
HT = [3.0, 5.0, 10.0, 15.0, 30.0, 60.0]
HL = [60.0, 90.0, 120.0, 180.0, 240.0, 300.0, 360.0, 480.0, 600.0]


def hs(values) -> str:
    return "(select unnest([" + ", ".join(f"{h}e0" for h in values) + "]) as h) hh"


NEAR_BOOK = f"""x as (select sample_id, s, mid, micro, first_value(mid) over w as mid_now, first_value(micro) over w as micro_now from bk0 window w as (partition by sample_id order by s)),
    y as (select *, row_number() over (partition by sample_id, h order by abs(s-h), s) as r from x cross join {hs(HS)})"""


@check("j6_nearest", views="bk0", ctes=NEAR_BOOK, select="select sample_id, h, r6(s) as at, r6(mid) as mid, r6(micro) as micro from y where r=1")
def nearest(e: Episodes):
    return round6_all(J.nearest(e.market.map(book.with_book), HS, ["mid", "micro"]))



@check("e9_horizon_book", views="bk0", ctes=NEAR_BOOK + ", z as (select h, r6(mid_now-mid) as dm, r6(micro_now-micro) as du from y where r=1)",
       select="""select h, count(dm) as n_mid, r6(stddev_pop(dm)) as std_mid, r6(avg(case when dm is null then null when dm=0 then 1e0 else 0e0 end)) as zero_mid,
         count(du) as n_micro, r6(stddev_pop(du)) as std_micro, r6(avg(case when du is null then null when du=0 then 1e0 else 0e0 end)) as zero_micro from z group by h""")
def horizon_book(e: Episodes):
    tape = e.market.map(book.with_book)
    now = newest_rows(tape, 1).select("sample_id", F.col("mid").alias("m0"), F.col("micro").alias("u0"))
    z = J.nearest(tape, HS, ["mid", "micro"]).join(now, "sample_id")
    z = round6_all(z.select("h", (F.col("m0") - F.col("mid")).alias("dm"), (F.col("u0") - F.col("micro")).alias("du")), "h")
    part = lambda c, n: D.horizon_spread(z, c).select("h", F.col("n").alias(f"n_{n}"), F.col("std").alias(f"std_{n}"), F.col("zero_share").alias(f"zero_{n}"))
    return round6_all(part("dm", "mid").join(part("du", "micro"), "h"), "h")


@check("e9_horizon_trades", views="trade",
       ctes=f"""x as (select *, first_value(price) over (partition by sample_id order by s, l_orderkey, l_linenumber, l_partkey) as now from trade),
         y as (select *, row_number() over (partition by sample_id, h order by abs(s-h), s, l_orderkey, l_linenumber, l_partkey) as r from x cross join {hs(HT)}), z as (select h, r6(now-price) as d from y where r=1)""",
       select="select h, count(d) as n, r6(stddev_pop(d)) as std, r6(avg(case when d=0 then 1e0 else 0e0 end)) as zero_share from z group by h")
def horizon_trades(e: Episodes):
    now = newest_rows(e.trade, 1).select("sample_id", F.col("price").alias("now"))
    z = J.nearest(e.trade, HT, ["price"]).join(now, "sample_id")
    return round6_all(D.horizon_spread(round6_all(z.select("h", (F.col("now") - F.col("price")).alias("change")), "h")), "h")


NEARP = f"""x as (select sample_id, s, transaction_avgprice as p, row_number() over (partition by sample_id order by s) - 1 as idx from market),
    now as (select sample_id, arg_min(p, idx) as now from x where p is not null group by 1),
    j as (select sample_id, h, arg_min(idx, struct_pack(a := abs(s-h), b := s)) as j from x cross join {hs(HL)} group by 1,2),
    c as (select j.sample_id, j.h, x.p, row_number() over (partition by j.sample_id, j.h order by abs(x.idx-j.j), x.idx<j.j) as r
      from j join x on x.sample_id=j.sample_id and abs(x.idx-j.j)<=4 where x.p is not null)"""


@check("j7_nearest_present", views="market", ctes=NEARP, select="select sample_id, h, r6(now) as now, r6(p) as \"then\" from c join now using (sample_id) where r=1")
def nearest_present(e: Episodes):
    return round6_all(J.nearest_present(e.market, HL, "transaction_avgprice"), "h")


@check("e9_horizon_avgprice", views="market months", ctes=NEARP + ", z as (select month, h, r6(now-p) as d from c join now using (sample_id) join months using (sample_id) where r=1)",
       select="select month, h, count(d) as n, r6(stddev_pop(d)) as std, r6(avg(case when d=0 then 1e0 else 0e0 end)) as zero_share from z group by 1,2")
def horizon_avgprice(e: Episodes):
    z = J.nearest_present(e.market, HL, "transaction_avgprice").join(e.months, "sample_id")
    z = round6_all(z.select("month", "h", (F.col("now") - F.col("then")).alias("change")), "h")
    return round6_all(D.horizon_spread(z, keys=("month", "h")), "h")


@check("e9_shape", views="market", ctes=NEARP + ", z as (select r6(now-p) as d from c join now using (sample_id) where r=1 and h=240)",
       select="select r6(kurtosis(d)) as kurt, r6(skewness(d)) as skew, r6(quantile_cont(abs(d),0.99)) as q99, r6(quantile_cont(abs(d),0.999)) as q999 from z")
def shape(e: Episodes):
    z = J.nearest_present(e.market, [240.0], "transaction_avgprice")
    return round6_all(D.shape(round6_all(z.select((F.col("now") - F.col("then")).alias("d"))), "d", hot=e.hot_all, limit=e.limit))
