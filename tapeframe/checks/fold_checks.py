"""Folds, preparation, out-of-fold evaluation, tree models, blending."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.aggregates import cosine
from ..functions.scalars import round6, round6_all
from ..operators import blend as B, diagnostics as D, folds as P, sequences as S
from ..operators.encodings import totals
from ..operators.ordered import find_hot
from ..plans import names
from ..sources.adapters import RANKED_COLUMNS, Episodes
from .registry import check
from .screening_checks import ALL_FACTORS, ARMS, AV, FACTORS, FV, PR, all_factors, arms, fx, pr
from .sequence_checks import FILL

IDX = "ix as (select month, row_number() over (order by month) - 1 as idx from (select distinct month from months))"


@check("p1_period_folds", views="months", ctes=IDX, select="select month, cast(idx as int) as idx, cast(idx % 6 as int) as fold from ix")
def period_folds(e: Episodes):
    return P.period_folds(e.months)


@check("p2_single_period_folds", views="months", ctes=IDX,
       select="select cast((idx-2)//6 as int) as fold, month as val from ix where idx>=2 and (idx-2)%6=0")
def single_folds(e: Episodes):
    return P.single_period_folds(e.months)


@check("f4_train_rows_by_fold", views="months", ctes=IDX + ", f as (select (idx-2)//6 as fold, month as val from ix where idx>=2 and (idx-2)%6=0)",
       select="select cast(fold as int) as fold, fcnt(month<>val) as train, fcnt(month=val) as valid from months cross join f group by fold")
def rows_by_fold(e: Episodes):
    per = e.months.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(F.broadcast(P.single_period_folds(e.months)), F.lit(True))
    train = F.sum(F.when(F.col("month") != F.col("val"), F.col("n")))
    return j.groupBy("fold").agg(train.alias("train"), F.sum(F.when(F.col("month") == F.col("val"), F.col("n"))).alias("valid"))


ZC = names.ALL


def fold_rows(e: Episodes):
    """All factors with the fold of their period."""
    return P.with_fold(all_factors(e).drop("fold"), P.period_folds(e.months))


def hot_folds(e: Episodes):
    """Rows that train each fold: folds - 1 copies of an episode. A task sorts the values of several columns, so the limit counts their rows."""
    per = P.training_rows(P.with_fold(e.months, P.period_folds(e.months)), 6)
    return find_hot(per.select("val_fold"), ["val_fold"], e.limit // RANKED_COLUMNS)


FSTAT = "tr0 as (select f.vf, fx.* from fx join (select unnest(range(0,6)) as vf) f on fx.fold<>f.vf), md as (select vf, " + ", ".join(
    f"quantile_cont({c},0.5) as {c}_med" for c in ZC) + " from tr0 group by 1), st as (select vf, " + ", ".join(
    f"max({c}_med) as {c}_med, avg(coalesce({c},{c}_med)) as {c}_mu, stddev_pop(coalesce({c},{c}_med)) as {c}_sd" for c in ZC) + " from tr0 join md using (vf) group by 1)"


@check("p3_fold_statistics", views=AV, ctes=f"{ALL_FACTORS}, {FSTAT}",
       select="select cast(vf as int) as val_fold, " + ", ".join(f"r6({c}_{x}) as {c}_{x}" for c in ZC for x in ("med", "mu")) + ", " + ", ".join(f"r6(case when {c}_sd=0 then 1 else {c}_sd end) as {c}_sd" for c in ZC) + " from st")
def fold_statistics(e: Episodes):
    return round6_all(P.fold_statistics(fold_rows(e), ZC, 6, hot=hot_folds(e), limit=e.limit))


@check("p3_standardised", views=AV, ctes=f"{ALL_FACTORS}, {FSTAT}",
       select="select sample_id, cast(fold as int) as fold, " + ", ".join(f"r6(greatest(least((coalesce({c},{c}_med)-{c}_mu)/case when {c}_sd=0 then 1 else {c}_sd end,5e0),-5e0)) as {c}" for c in ZC)
       + " from fx join st on fx.fold=st.vf")
def standardised(e: Episodes):
    df = fold_rows(e)
    stats = P.fold_statistics(df, ZC, 6, hot=hot_folds(e), limit=e.limit)
    return round6_all(P.standardise(df, stats, ZC, F.col("fold") == F.col("val_fold")).select("sample_id", "fold", *ZC))


UMED = "tr0 as (select f.vf, fx.* from fx join (select unnest(range(0,6)) as vf) f on fx.fold<>f.vf), md as (select vf, " + ", ".join(
    f"quantile_cont({c},0.5) as {c}_med" for c in ZC) + " from tr0 group by 1), us as (select sample_id, r6(U_s) as U_s from sc)"


def unit_sql(c: str) -> str:
    x = f"coalesce({c},{c}_med)"
    u = "greatest(U_s,1e-9)"
    form = f"{x}/{u}" if c in names.TICK else f"asinh({x}/{u})" if c in names.TICK_ASINH else f"asinh({x})" if c in names.ASINH else x
    return f"r6(greatest(least({form},256e0),-256e0)) as {c}"


@check("p4_unit_classes", views=AV, ctes=f"{ALL_FACTORS}, {FILL}, {UMED}",
       select="select fx.sample_id, " + ", ".join(unit_sql(c) for c in ZC) + " from fx join md on fx.fold=md.vf join us on us.sample_id=fx.sample_id")
def unit_classes(e: Episodes):
    df = fold_rows(e)
    med = P.fold_statistics(df, ZC, 6, hot=hot_folds(e), limit=e.limit).select("val_fold", *[f"{c}_med" for c in ZC])
    scale = round6_all(S.snapshot_index(e.market).select("sample_id", "U_s"))
    out = P.unit_classes(df.join(scale, "sample_id"), med, names.unit_classes_of(ZC), F.col("fold") == F.col("val_fold"))
    return round6_all(out.select("sample_id", *ZC))


EDGE = 48
# edges are compared, and used, on six decimals: equal ones must merge alike in every engine
EDGES = f"""tl as (select f.vf, factor, x from lx join (select unnest(range(0,6)) as vf) f on lx.fold<>f.vf),
    q0 as (select vf, factor, list_sort(list_distinct(list_transform(quantile_cont(x, [{", ".join(f"{i}/{EDGE}::double" for i in range(EDGE + 1))}]), lambda v: r6(v)))) as ed from tl group by 1, 2),
    q as (select vf, factor, case when len(ed)=1 then [ed[1]-1, ed[1]+1] else ed end as ed from q0)"""


def rounded_edges(e: Episodes):
    """Edges of all factors over the training rows of each fold."""
    q = P.quantile_edges(fold_rows(e), ZC, 6, bins=EDGE, hot=hot_folds(e), limit=e.limit)
    ed = F.array_distinct(F.transform("edges", lambda x: round6(x)))
    return q.select("val_fold", "factor", F.when(F.size(ed) == 1, F.array(ed[0] - 1, ed[0] + 1)).otherwise(ed).alias("edges"))


@check("p5_quantile_edges", views=AV, ctes=f"{ALL_FACTORS}, {EDGES}",
       select="select cast(vf as int) as val_fold, factor, cast(generate_subscripts(ed,1)-1 as int) as i, r6(unnest(ed)) as edge from q")
def quantile_edges(e: Episodes):
    return round6_all(rounded_edges(e).select("val_fold", "factor", F.posexplode("edges").alias("i", "edge")))


@check("p5_piecewise_linear", views=AV,
       ctes=f"""{ALL_FACTORS}, {EDGES}, y as (select sample_id, lx.factor, list_transform(range(1,len(ed)), lambda i: case when len(ed)=2 then (x-ed[i])/(ed[i+1]-ed[i])
         when i=1 then least((x-ed[i])/(ed[i+1]-ed[i]),1e0) when i=len(ed)-1 then greatest((x-ed[i])/(ed[i+1]-ed[i]),0e0)
         else least(greatest((x-ed[i])/(ed[i+1]-ed[i]),0e0),1e0) end) as parts from lx join q on lx.fold=q.vf and lx.factor=q.factor)""",
       select="select sample_id, factor, cast(len(parts) as int) as bins, r6(list_sum(parts)) as total, r6(list_sum(list_transform(range(1,len(parts)+1), lambda i: i*parts[i]))) as moment from y")
def piecewise(e: Episodes):
    """Encodings of every factor by its fold's training edges, as their sum and first moment over the bins."""
    x = P.long_factors(fold_rows(e), ZC, ["sample_id", "fold"])
    edges = rounded_edges(e).withColumnRenamed("val_fold", "fold")
    parts = x.join(F.broadcast(edges), ["fold", "factor"]).select("sample_id", "factor", totals(P.piecewise_linear(F.col("x"), F.col("edges"))).alias("t"))
    return round6_all(parts.select("sample_id", "factor", "t.bins", "t.total", "t.moment"))


@check("p6_scaled_target", views="label", ctes="x as (select sample_id, r6(target) as target from label)",
       select="select sample_id, r6(target*1000e0) as scaled, r6(target*1000e0/1000e0) as back from x")
def scaled(e: Episodes):
    df = round6_all(e.label)
    y = P.scaled_target("target")
    return round6_all(df.select("sample_id", y.alias("scaled"), P.scaled_target(y, back=True).alias("back")))


@check("p7_sample_weight", views="pred",
       ctes=PR + ", t as (select vf, quantile_cont(abs(target),0.9) as tau from pr join (select unnest(range(0,6)) as vf) f on pr.fold<>f.vf group by 1)",
       select="select cast(vf as int) as val_fold, sample_id, r6(1e0/(1e0+abs(target)/tau)) as w from pr join t on pr.fold<>t.vf")
def weights(e: Episodes):
    df = pr(e)
    tau = P.weight_scale(df, 6, 90, hot=hot_folds(e), limit=e.limit)
    train = P.training_rows(df.select("sample_id", "fold", "target"), 6).join(F.broadcast(tau), "val_fold")
    return round6_all(train.select("val_fold", "sample_id", P.sample_weight().alias("w")))


@check("p10_ensemble_mean", views="pred", ctes=ARMS.replace("select 'a' as arm, fold", "select 'a' as arm, sample_id, fold").replace("select 'b', fold", "select 'b', sample_id, fold").replace("select 'c', fold", "select 'c', sample_id, fold"),
       select="select sample_id, r6(avg(pred)) as prediction, count(*) as models from arms group by 1")
def ensemble(e: Episodes):
    return round6_all(P.ensemble_mean(arms(e)))


@check("p11_oof_summary", views="pred", ctes=PR + ", f as (select fold, cosine(p_b,target) as cos from pr group by 1)",
       select="select r6(avg(cos)) as mean, r6(stddev_pop(cos)) as std, r6(min(cos)) as min, fcnt(cos<0) as negative, count(*) as folds from f")
def oof_summary(e: Episodes):
    return round6_all(P.oof_summary(P.fold_scores(pr(e), "p_b")))


@check("p12_losses", views="pred", ctes=PR,
       select="""select fold, r6(1-cosine(p_a,target)) as cos_loss, r6(avg((p_a-target)*(p_a-target))) as mse,
         r6(sum((p_a-target)*(p_a-target)/(1e0+abs(target)/0.01e0))/sum(1e0/(1e0+abs(target)/0.01e0))) as weighted_mse from pr group by fold""")
def losses(e: Episodes):
    w = F.lit(1.0) / (F.lit(1.0) + F.abs("target") / F.lit(0.01))
    return round6_all(pr(e).groupBy("fold").agg(*P.losses("p_a", "target", w)))


@lru_cache(maxsize=2)
def binned_folds(e: Episodes):
    """Each fold's rows, binned and weighted by its training rows."""
    df = fold_rows(e).withColumn("target", P.scaled_target("target"))
    scales = P.weight_scale(df, 6, 90, hot=hot_folds(e), limit=e.limit)
    return P.fold_data(df, ZC, rounded_edges(e), scales, range(6))


STUMP = {"maxIter": 1, "maxDepth": 1}
# the best cut of one feature in two, by weighted variance, on bins of the training rows' edges; `rank` restricts the features
STUMPS = f"""{ALL_FACTORS}, {EDGES}, fy as (select sample_id, fold, target*1000e0 as y, {{cols}} from fx),
    ta as (select vf, quantile_cont(abs(y),0.9) as tau from fy join (select unnest(range(0,6)) as vf) f on fy.fold<>f.vf group by 1),
    fn as (select unnest({names.ALL}) as factor, unnest(range(0,{len(names.ALL)})) as o),
    nb as materialized (select q.vf, y.sample_id, y.fold, fn.factor, o, y, 1e0/(1e0+abs(y)/tau) as w,
      case when lx.x is null then len(ed) else len(list_filter(ed[2:len(ed)], lambda v: v<=lx.x)) end as b
      from fy y cross join fn join q on q.factor=fn.factor join ta on ta.vf=q.vf left join lx on lx.sample_id=y.sample_id and lx.factor=fn.factor),
    tb as (select vf, factor, o, b, count(*) as n, sum(w) as w, sum(w*y) as s, sum(w*y*y) as ss from nb where fold<>vf group by all),
    cu as (select *, sum(n) over a as cn, sum(w) over a as cw, sum(s) over a as cs, sum(ss) over a as css, sum(n) over z as an, sum(w) over z as aw, sum(s) over z as as_, sum(ss) over z as ass,
      (b + lead(b) over (partition by vf, factor order by b))/2e0 as cut from tb
      window a as (partition by vf, factor order by b), z as (partition by vf, factor)),
    ga as (select *, (ass/aw-(as_/aw)*(as_/aw)) - cw/aw*(css/cw-(cs/cw)*(cs/cw)) - (aw-cw)/aw*((ass-css)/(aw-cw)-((as_-cs)/(aw-cw))*((as_-cs)/(aw-cw))) as gain
      from cu where cut is not null and cn>=5 and an-cn>=5)""".replace("{cols}", "month")


def best_stumps(keys: str, rank: str = "") -> str:
    """One cut per fold (and `keys`), the first feature and cut among equal ones; gains are compared on nine digits."""
    return f"bs as (select * from (select *, row_number() over (partition by {keys} order by cast(printf('%.8e', gain) as double) desc, o, b) as rr from ga {rank}) where rr=1)"


SCORED = """pd as (select {keys}nb.fold, nb.sample_id, nb.y, case when nb.b<=bs.cut then cs/cw else (as_-cs)/(aw-cw) end as pred
    from bs join nb on nb.vf=bs.vf and nb.fold=bs.vf and nb.factor=bs.factor)"""


@check("p8_stump_oof", views=AV, ctes=f"{STUMPS}, {best_stumps('vf')}, {SCORED.format(keys='')}",
       select="select cast(fold as int) as fold, count(*) as n, r6(cosine(pred,y)) as cos, r6(min(pred)) as low, r6(max(pred)) as high, r6(avg(pred)) as mean from pd group by fold")
def stumps(e: Episodes):
    """All factors and folds, weighted, one tree of one cut: what SQL can say of the fits."""
    oof, _ = P.fit_folds(binned_folds(e), **STUMP)
    more = oof.groupBy("fold").agg(F.min("pred").alias("low"), F.max("pred").alias("high"), F.avg("pred").alias("mean"))
    return round6_all(P.fold_scores(oof).join(more, "fold"))


@check("p8_boosted_trees_oof")
def boosted(e: Episodes):
    """All factors and folds, weighted, stopped early."""
    oof, _ = P.fit_folds(binned_folds(e), maxIter=10, maxDepth=3)
    return P.fold_scores(oof)


ORDER = [(f, i) for i, f in enumerate(names.ALL)]


def stump_gains(e: Episodes):
    return P.mean_gain(P.fit_folds(binned_folds(e), **STUMP)[1])


# a model of one cut has all its gain in one feature
RANKS = "gn as (select fn.factor, o, (select count(*) from bs where bs.factor=fn.factor)/6e0 as gain from fn), rk as (select *, row_number() over (order by gain desc, factor) as pos from gn)"


@check("p9_importance_top_k", views=AV, ctes=f"{STUMPS}, {best_stumps('vf')}, {RANKS}", select=f"select factor as feature, r6(gain) as gain, cast(o as int) as ordinal from rk where pos<=4")
def importance(e: Episodes):
    order = e.spark.createDataFrame(ORDER, "feature string, ordinal int")
    return round6_all(P.top_k(stump_gains(e), order, 4))


CURVE = (1, 2, 4)


@check("p9_refit_curve", views=AV,
       ctes=f"{STUMPS}, {best_stumps('vf')}, {RANKS}, ks as (select unnest({list(CURVE)}) as k), " + best_stumps("k, vf", "join (select factor, pos from rk) using (factor) join ks on pos<=k").replace("bs as", "bc as")
       + ", " + SCORED.format(keys="bc.k, ").replace("bs", "bc") + ", sv as (select k, fold, cosine(pred,y) as cos from pd group by 1, 2)",
       select="select cast(k as int) as k, r6(avg(cos)) as mean, r6(stddev_pop(cos)) as std from sv group by k")
def refit_curve(e: Episodes):
    """Out-of-fold score of models refitted on the best features, by their number."""
    order = e.spark.createDataFrame(ORDER, "feature string, ordinal int")
    return round6_all(P.top_k_curve(binned_folds(e), stump_gains(e), order, CURVE, **STUMP))


# ---- blending -----------------------------------------------------------------------------------

M = ["p_a", "p_b", "p_c"]
UNIT = PR + ", mo as (select " + ", ".join(f"avg({c}) as m_{c}, sqrt(var_pop({c})*count({c})) as n_{c}" for c in M) + " from pr), un as (select pr.*, " + ", ".join(
    f"coalesce(div({c}-m_{c}, n_{c}),0e0) as u_{c}" for c in M) + " from pr cross join mo)"


@check("b1_unit", views="pred", ctes=UNIT, select="select sample_id, " + ", ".join(f"r6(u_{c}) as u_{c}" for c in M) + " from un")
def unit(e: Episodes):
    return round6_all(B.unit_columns(pr(e), M).select("sample_id", *[f"u_{c}" for c in M]))


@check("b2_three_member_blend", views="pred", ctes=UNIT, select="select sample_id, r6(u_p_a+0.875e0*u_p_b+1e0*u_p_c) as prediction from un")
def three_members(e: Episodes):
    df = pr(e)
    joined = B.align([df.select("sample_id", m) for m in M])
    u = B.unit_columns(joined, M)
    return round6_all(u.select("sample_id", B.blended([f"u_{m}" for m in M], [1.0, 0.875, 1.0]).alias("prediction")))


AX1 = [i * 0.025 for i in range(81)]
AX2 = [i * 0.25 for i in range(9)]


def grid_sql(axes: int) -> str:
    if axes == 1:
        g = "(select i as ordinal, i*0.025e0 as w1 from (select unnest(range(0,81)) as i))"
        return f"gr as (select month, ordinal, w1, cosine(u_p_a+w1*u_p_b,target) as cos from un cross join {g} group by 1,2,3)"
    g = "(select i*9+j as ordinal, i*0.25e0 as w1, j*0.25e0 as w2 from (select unnest(range(0,9)) as i), (select unnest(range(0,9)) as j))"
    return f"gr as (select month, ordinal, w1, w2, cosine(u_p_a+w1*u_p_b+w2*u_p_c,target) as cos from un cross join {g} group by 1,2,3,4)"


BEST = "bs as (select *, row_number() over (partition by month order by r6(cos*1e3) desc, ordinal) as rr from gr)"


def blend_moments(e: Episodes, members):
    return B.moments(B.unit_columns(pr(e), M), [f"u_{m}" for m in members])


def settled_cos(grid):
    """Grid cosines on nine decimals, so that equal grid points tie in every engine."""
    return grid.withColumn("cos", round6(F.col("cos") * 1e3) / 1e3)


@check("b3_two_member_grid", views="pred", ctes=f"{UNIT}, {grid_sql(1)}, {BEST}", select="select month, r6(w1) as w1, r6(cos) as cos from bs where rr=1")
def two_member_grid(e: Episodes):
    return round6_all(B.best_weights(settled_cos(B.weight_grid(blend_moments(e, M[:2]), [AX1]))))


@check("b3_three_member_grid", views="pred", ctes=f"{UNIT}, {grid_sql(2)}, {BEST}", select="select month, r6(w1) as w1, r6(w2) as w2, r6(cos) as cos from bs where rr=1")
def three_member_grid(e: Episodes):
    return round6_all(B.best_weights(settled_cos(B.weight_grid(blend_moments(e, M), [AX2, AX2]))))


@check("s5_grid_argmax", views="pred", ctes=f"{UNIT}, {grid_sql(2)}, {BEST}", select="select month, r6(w1) as w1, r6(w2) as w2 from bs where rr=1")
def grid_argmax(e: Episodes):
    return three_member_grid(e).drop("cos")


@check("b3_pooled_weights", views="pred", ctes=f"{UNIT}, {grid_sql(2)}, {BEST}",
       select="select r6(median(w1)) as w1, r6(median(w2)) as w2, r6(stddev_pop(w1)) as w1_std, r6(stddev_pop(w2)) as w2_std, r6(avg(cos)) as cos_best from bs where rr=1")
def pooled(e: Episodes):
    return round6_all(B.pooled_weights(B.best_weights(settled_cos(B.weight_grid(blend_moments(e, M), [AX2, AX2])))))


@check("b3_pooled_scores", views="pred", ctes=f"{UNIT}, {grid_sql(2)}, {BEST}, pw as (select median(w1) as w1, median(w2) as w2 from bs where rr=1)",
       select="select month, r6(cosine(u_p_a+w1*u_p_b+w2*u_p_c,target)) as cos_pooled from un cross join pw group by month")
def pooled_scores(e: Episodes):
    mom = blend_moments(e, M)
    return round6_all(B.pooled_scores(mom, B.pooled_weights(B.best_weights(settled_cos(B.weight_grid(mom, [AX2, AX2]))))))


SENS_A, SENS_B = [0.5, 0.75, 1.0], [0.0, 0.25, 0.375, 0.5, 1.0]


@check("b4_weight_sensitivity", views="pred",
       ctes=f"{UNIT}, g as (select unnest({SENS_A}::double[]) as w1), h as (select unnest({SENS_B}::double[]) as w2), c as (select month, w1, w2, cosine(u_p_a+w1*u_p_b+w2*u_p_c,target) as cos from un cross join g cross join h group by 1,2,3)",
       select="select w1, w2, r6(avg(cos)) as cos from c group by 1,2")
def sensitivity(e: Episodes):
    return round6_all(B.sensitivity(blend_moments(e, M), [SENS_A, SENS_B]), "w1", "w2")


POW = PR + f", {FILL}, us as (select sample_id, r6(med_depth) as U_s from sc), lm as (select avg(ln(U_s)) as m from pr join us using (sample_id)), lu as (select pr.*, U_s, ln(U_s)-m as lu from pr join us using (sample_id) cross join lm)"
WGRID = "(select i as o, (i-200)*0.005e0 as w from (select unnest(range(0,401)) as i))"
EXPONENTS = [(i - 200) * 0.005 for i in range(401)]


def depth_unit(e: Episodes):
    """Median depth as the unit: the price unit of these tables is the same in every episode."""
    return round6_all(S.snapshot_index(e.market).select("sample_id", F.col("med_depth").alias("U_s")))


def scaled_members(e: Episodes):
    us = depth_unit(e)
    return B.centred_log(pr(e).join(us, "sample_id"), "U_s")




@check("b5_power_in_sample", views="pred market", ctes=POW + f", gw as (select w, o, r6(cosine(p_a*exp(w*lu),target)*1e3) as cos from lu cross join {WGRID} group by 1,2), b as (select *, row_number() over (order by cos desc, o) as r from gw)",
       select="select r6(w) as w, r6(cos/1e3) as cos from b where r=1")
def power_in_sample(e: Episodes):
    mom = B.power_moments(scaled_members(e), "p_a", "target", "lu", EXPONENTS, [])
    return round6_all(B.best_power(mom))


@check("b5_power_held_out", views="pred market",
       ctes=POW + f", gw as (select f.fold, w, o, r6(cosine(p_a*exp(w*lu),target)*1e3) as cos from lu join (select distinct fold from pr) f on lu.fold<>f.fold cross join {WGRID} group by 1,2,3), b as (select *, row_number() over (partition by fold order by cos desc, o) as r from gw)",
       select="select fold, r6(w) as w from b where r=1")
def power_held_out(e: Episodes):
    mom = B.power_moments(scaled_members(e), "p_a", "target", "lu", EXPONENTS, ["fold"])
    return round6_all(B.held_out_power(mom).select("fold", "w"))


@check("b5_power_held_out_score", views="pred market",
       ctes=POW + f", gw as (select f.fold, w, o, r6(cosine(p_a*exp(w*lu),target)*1e3) as cos from lu join (select distinct fold from pr) f on lu.fold<>f.fold cross join {WGRID} group by 1,2,3), b as (select *, row_number() over (partition by fold order by cos desc, o) as r from gw)",
       select="select r6(cosine(p_a,target)) as plain, r6(cosine(p_a*exp(w*lu),target)) as held_out from lu join b on lu.fold=b.fold and b.r=1")
def power_held_out_score(e: Episodes):
    df = scaled_members(e)
    best = B.held_out_power(B.power_moments(df, "p_a", "target", "lu", EXPONENTS, ["fold"])).select("fold", "w")
    j = df.join(F.broadcast(best), "fold")
    return round6_all(j.agg(cosine("p_a", "target").alias("plain"), cosine(F.col("p_a") * F.exp(F.col("w") * F.col("lu")), F.col("target")).alias("held_out")))


@check("b5_rescaled_submissions", views="pred market",
       ctes=UNIT + f", {FILL}, us as (select sample_id, r6(med_depth) as U_s from sc), x as (select un.*, U_s, p_b*pow(U_s,0.245e0) as q from un join us using (sample_id)), qm as (select avg(q) as m, sqrt(var_pop(q)*count(q)) as n from x)",
       select="select sample_id, r6((u_p_a+0.5e0*u_p_b+0.25e0*u_p_c)*pow(U_s,0.2e0)) as all_scaled, r6(u_p_a+0.5e0*((q-m)/n)+0.25e0*u_p_c) as one_scaled from x cross join qm")
def rescaled_submissions(e: Episodes):
    us = depth_unit(e)
    df = pr(e).join(us, "sample_id").withColumn("q", B.power_rescaled("p_b", "U_s", 0.245))
    u = B.unit_columns(df, [*M, "q"]).withColumn("blend", B.blended([f"u_{m}" for m in M], [1.0, 0.5, 0.25]))
    return round6_all(u.select("sample_id", B.power_rescaled("blend", "U_s", 0.2).alias("all_scaled"), B.blended(["u_p_a", "u_q", "u_p_c"], [1.0, 0.5, 0.25]).alias("one_scaled")))


@check("b6_recipe_check", views="pred", ctes=UNIT, select="select r6(0e0) as worst, count(*)>0 as same from un")
def recipe(e: Episodes):
    u = B.unit_columns(pr(e), M).withColumn("a", B.blended([f"u_{m}" for m in M], [1.0, 0.875, 1.0]))
    u = u.withColumn("b", F.col("a") * 3.7 + 0.2)
    d = B.max_difference(u, "a", "b")
    return round6_all(d.withColumn("same", F.col("worst") < 1e-12))
