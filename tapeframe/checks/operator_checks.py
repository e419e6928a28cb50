"""Generic sources, filters, joins, aggregates, windows, sorts, set operations and scalars, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import aggregates as A
from ..functions.scalars import clip, decay, div, imbalance, nullify_nonfinite, round6_all, signed
from ..operators import grid, joins as J, quality as Q, quantiles, sequences as S
from ..operators.folds import top_k
from ..operators.ordered import oldest_row, ordered, with_group_values
from ..plans import book, cross, trade
from ..plans.order import flow_sign
from ..sources import tables
from ..sources.adapters import Episodes
from ..sources.shared import scratch_path
from .registry import check
from .factor_checks import ASOF
from .screening_checks import ARMS, FACTORS, FV, PR, arms, fx, pr
from .sequence_checks import FILL
from .sql import TIES

# ---- sources and sinks --------------------------------------------------------------------------


def scratch(e: Episodes, name: str) -> str:
    return scratch_path(e.spark, name)


def as_event_table(e: Episodes):
    df = e.trade.df.select("sample_id", F.col("s").alias("seconds_before_predict"), "price", "volume", F.col("side").cast("byte").alias("side"))
    return schema.validate_schema(df, schema.TRADE)


@check("io1_convert", views="trade", select="select count(*) as rows, r6(sum(volume)) as volume from trade")
def convert(e: Episodes):
    path = scratch(e, "trade.parquet")
    tables.convert(as_event_table(e), path)
    tables.convert(as_event_table(e).limit(0), path)  # an existing target stays as it is
    back = tables.read_table(e.spark, path, schema.TRADE)
    return round6_all(back.agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume")))


@check("io2_scan_with_fallback", views="trade", select="select sample_id, count(*) as rows, r6(sum(price)) as price from trade group by 1")
def fallback(e: Episodes):
    path = scratch(e, "trade.orc")
    as_event_table(e).write.orc(path)
    df = tables.read_table(e.spark, path + ".missing", schema.TRADE, fallback=[("orc", path)])
    return round6_all(df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("price")))


@check("io3_projected_scan", select="select l_suppkey, r6(l_extendedprice) as l_extendedprice from lineitem")
def projected(e: Episodes):
    return round6_all(e.table("lineitem").select("l_suppkey", "l_extendedprice"))


@check("io4_period_union", views="label", select="select month, count(*) as rows, r6(sum(target)) as target from label group by 1")
def period_union(e: Episodes):
    path = scratch(e, "labels")
    tables.write_periods(e.label, path)
    both = tables.read_periods(e.spark, [f"{path}/month=*"], base=path)
    return round6_all(both.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").alias("target")))


@check("io5_csv_ids", views="months", select="select sample_id from months")
def csv_ids(e: Episodes):
    path = scratch(e, "ids.csv")
    e.months.select("sample_id", F.lit(0.0).alias("prediction")).write.option("header", True).csv(path)
    return tables.read_ids(e.spark, path)


@check("io6_period_sink", views="label", select="select sample_id, month, r6(case when month=3 then target+1e0 else target end) as target from label")
def period_sink(e: Episodes):
    path = scratch(e, "factors")
    tables.write_periods(e.label, path)
    redo = e.label.where("month = 3").withColumn("target", F.col("target") + 1)
    tables.write_periods(redo, path)  # replaces its own period only
    return round6_all(e.spark.read.parquet(path).select("sample_id", "month", "target"))


@check("io8_oof_source", views="pred", ctes=PR, select="select sample_id, r6(p_a) as pred from pr")
def oof_source(e: Episodes):
    folder = scratch(e, "oof")
    df = pr(e).select("sample_id", F.col("p_a").alias("pred"), "fold")
    for k in range(6):
        df.where(F.col("fold") == k).drop("fold").write.parquet(f"{folder}/f{k}.parquet")
    return round6_all(tables.read_oof(e.spark, folder))


@check("io7_oof_sink", views="pred", ctes=ARMS.replace("as arm, fold", "as arm, sample_id, fold").replace("'b', fold", "'b', sample_id, fold").replace("'c', fold", "'c', sample_id, fold"),
       select="select arm, cast(fold as int) as fold, count(*) as rows, r6(sum(pred)) as pred from arms group by 1,2")
def oof_sink(e: Episodes):
    path = scratch(e, "oof")
    tables.write_oof(arms(e).select("arm", "fold", "sample_id", "pred"), path)
    tables.write_oof(arms(e).where("arm = 'b'").select("arm", "fold", "sample_id", "pred"), path)  # one arm again
    back = e.spark.read.parquet(path)
    return round6_all(back.groupBy("arm", "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("pred").alias("pred")))


# ---- filters and projections --------------------------------------------------------------------


@check("f1_key_range", views="trade", ctes="k as (select min(sample_id) as lo, max(sample_id) as hi from trade)",
       select="select sample_id, r6(sum(volume)) as volume from trade cross join k where sample_id between lo and (lo+hi)//2 group by 1")
def key_range(e: Episodes):
    ends = F.broadcast(e.trade.df.agg(F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")))
    df = e.trade.df.crossJoin(ends).where(F.col("sample_id").between(F.col("lo"), F.floor((F.col("lo") + F.col("hi")) / 2)))
    return round6_all(df.groupBy("sample_id").agg(F.sum("volume").alias("volume")))


@check("f2_membership", views="trade label", select="select sample_id, count(*) as rows from trade where sample_id in (select sample_id from label where target < 0) group by 1")
def membership(e: Episodes):
    ids = e.label.where("target < 0").select("sample_id")
    return e.trade.df.join(ids, "sample_id", "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("rows"))


WINDOWS = (2, 5, 15, 30, 45, 60, 180)


@check("f3_look_back", views="market", select="select sample_id, " + ", ".join(f"r6(fsum(ask_volume_2, s<={w})) as v{w}, fcnt(s<={w}) as n{w}" for w in WINDOWS) + " from market group by 1")
def look_back(e: Episodes):
    s = F.col("s")
    return round6_all(e.market.df.groupBy("sample_id").agg(
        *[x for w in WINDOWS for x in (A.fsum("ask_volume_2", s <= w).alias(f"v{w}"), A.fcnt(s <= w).alias(f"n{w}"))]))


@check("f4_period_filter", views="label", select="select sample_id, r6(target) as target from label where month = 4")
def period_filter(e: Episodes):
    return round6_all(e.label.where("month = 4").select("sample_id", "target"))


@check("f5_conditional", views="ord", select="select sample_id, r6(sum(case when side=0 and order_action=0 then volume when side=0 then -volume when order_action=0 then -volume else volume end)) as flow from ord group by 1")
def conditional(e: Episodes):
    return round6_all(e.order.df.groupBy("sample_id").agg(F.sum(flow_sign() * F.col("volume")).alias("flow")))


@check("f6_validity", views="bk0", select="select sample_id, fcnt(valid) as quoted, fcnt(not valid) as one_sided from bk0 group by 1")
def validity(e: Episodes):
    return book.with_book(e.market.df).groupBy("sample_id").agg(A.fcnt(F.col("valid")).alias("quoted"), A.fcnt(~F.col("valid")).alias("one_sided"))


@check("f7_nonfinite_to_null", views="bk0", select="select sample_id, r6(s) as s, r6(case when tilt=0 then null else 1e0/tilt end) as inverse, r6(case when bid_price_1>0 then ln(bid_price_1) end) as log_bid from bk0")
def nonfinite(e: Episodes):
    inf = F.lit(float("inf"))
    df = book.with_book(e.market.df).select(
        "sample_id", "s", F.when(F.col("tilt") == 0, inf).otherwise(1 / F.col("tilt")).alias("inverse"),
        F.when(F.col("bid_price_1") > 0, F.ln("bid_price_1")).otherwise(F.lit(float("nan"))).alias("log_bid"),
    )
    return round6_all(nullify_nonfinite(df))


@check("f8_null_fill", views="market", select="select sample_id, r6(s) as s, r6(coalesce(transaction_volume,0e0)) as transaction_volume, r6(coalesce(transaction_avgprice,-1e0)) as transaction_avgprice from market")
def null_fill(e: Episodes):
    df = e.market.df.select("sample_id", "s", "transaction_volume", "transaction_avgprice")
    return round6_all(df.na.fill({"transaction_volume": 0.0, "transaction_avgprice": -1.0}))


@check("f9_clip", views="trade", select=f"select sample_id, r6(s) as s, {TIES}, r6(greatest(least(price, 2.5e0), 1.25e0)) as price from trade")
def clipped(e: Episodes):
    return round6_all(e.trade.df.select("sample_id", "s", *e.trade.ties, clip("price", 1.25, 2.5).alias("price")))


@check("f10_select_rename", views="trade", select="select side as direction, sample_id, r6(volume) as size from trade")
def renamed(e: Episodes):
    return round6_all(e.trade.df.drop("price", "s").withColumnRenamed("volume", "size").withColumnRenamed("side", "direction").select("direction", "sample_id", "size"))


# ---- joins --------------------------------------------------------------------------------------


@check("j1_wide_left_join", views="trade ord market", select="""select m.sample_id, m.n as snaps, t.n as trades, o.n as orders from (select sample_id, count(*) as n from market group by 1) m
       left join (select sample_id, count(*) as n from trade group by 1) t using (sample_id) left join (select sample_id, fcnt(order_action=1) as n from ord group by 1) o using (sample_id)""")
def wide_join(e: Episodes):
    n = lambda df, c, x=F.lit(1): df.groupBy("sample_id").agg(F.count(x).alias(c))
    gone = F.when(F.col("order_action") == 1, 1)
    return n(e.market.df, "snaps").join(n(e.trade.df, "trades"), "sample_id", "left").join(n(e.order.df, "orders", gone), "sample_id", "left")


@check("j2_label_join", views="calendar label", select="select sample_id, month, r6(target) as target from calendar left join label using (sample_id)")
def label_join(e: Episodes):
    return round6_all(e.calendar.join(e.label, "sample_id", "left").select("sample_id", "month", "target"))


@check("j3_two_key_join", views=FV, ctes=FACTORS, select="select a.sample_id, a.month, r6(a.t_imb*b.spread0) as product from fx a left join fx b on a.sample_id=b.sample_id and a.month=b.month")
def two_key_join(e: Episodes):
    a, b = fx(e, ("t_imb",)).select("sample_id", "month", "t_imb"), fx(e, ("spread0",)).select("sample_id", "month", "spread0")
    return round6_all(a.join(b, ["sample_id", "month"], "left").select("sample_id", "month", (F.col("t_imb") * F.col("spread0")).alias("product")))


@check("j4_oof_inner_join", views="pred", ctes=PR, select="select a.sample_id, r6(a.p_a) as pred, r6(b.p_b) as pred_new, a.target from pr a join pr b using (sample_id)")
def oof_join(e: Episodes):
    df = pr(e)
    a, b = df.select("sample_id", F.col("p_a").alias("pred"), "target"), df.select("sample_id", F.col("p_b").alias("pred_new"))
    return round6_all(a.join(b, "sample_id"), "target")


@check("j5_asof_forward", views="trade market",
       ctes=ASOF.replace("select t.sample_id, t.s,", f"select {', '.join('t.' + c.strip() for c in TIES.split(','))}, t.sample_id, t.s,"),
       select=f"select sample_id, {TIES}, r6(s) as s, r6(matched_at) as matched_at, r6(ask_price_1) as ask_price_1, r6(bid_price_1) as bid_price_1 from j")
def asof(e: Episodes):
    j = J.asof_forward(e.trade, e.market, ["ask_price_1", "bid_price_1"])
    return round6_all(j.select("sample_id", *e.trade.ties, "s", F.col("_matched_at").alias("matched_at"), "ask_price_1", "bid_price_1"))


NEXT_YEAR = "o1 as (select distinct sample_id, cast(round(s*10) as bigint) as t, price, volume, side, order_action from ord), o2 as (select distinct sample_id-1 as sample_id, t, price, volume, side, order_action from o1)"
SHIFTS = [i * 0.5 for i in range(1, 120)]


def year_pairs(e: Episodes):
    """Each episode against the supplier's next year, volume and direction as attributes."""
    a = e.order.df.select("sample_id", "s", "volume", "side", "order_action")
    return a, a.withColumn("sample_id", F.col("sample_id") - 1)


@check("j8_shift_match", views="ord",
       ctes=NEXT_YEAR.replace("price, ", "") + ", d as (select i*0.5e0 as d, i*5 as dt from (select unnest(range(1,120)) as i)), m as (select o1.sample_id, d, count(*) as events, count(o2.t) as matched from o1 join d on o1.t>=d.dt "
       "left join o2 on o2.sample_id=o1.sample_id and o2.t=o1.t-d.dt and o2.volume=o1.volume and o2.side=o1.side and o2.order_action=o1.order_action group by 1,2)",
       select="select sample_id, d, events, matched, r6(matched/cast(events as double)) as rate from m")
def shift_match(e: Episodes):
    a, b = year_pairs(e)
    return round6_all(J.shift_match(a, b, "sample_id", "s", ["volume", "side", "order_action"], SHIFTS, 0.1), "d")


@check("j8_best_shift", views="ord",
       ctes=NEXT_YEAR.replace("price, ", "") + ", d as (select i*0.5e0 as d, i*5 as dt from (select unnest(range(1,120)) as i)), m as (select o1.sample_id, d, count(o2.t)/cast(count(*) as double) as rate from o1 join d on o1.t>=d.dt "
       "left join o2 on o2.sample_id=o1.sample_id and o2.t=o1.t-d.dt and o2.volume=o1.volume and o2.side=o1.side and o2.order_action=o1.order_action group by 1,2), r as (select *, row_number() over (partition by sample_id order by rate desc, d) as rn from m)",
       select="select sample_id, d, r6(rate) as rate from r where rn=1")
def best_shift(e: Episodes):
    a, b = year_pairs(e)
    m = J.shift_match(a, b, "sample_id", "s", ["volume", "side", "order_action"], SHIFTS, 0.1)
    return round6_all(J.best_shift(m, "sample_id"), "d")


PRICE_BAND = 10  # prices of the adapter views hardly repeat between years; equal bands of this width do


@check("j8_price_match", views="ord",
       ctes=NEXT_YEAR.replace("price, ", f"cast(floor(price/{PRICE_BAND}e0) as bigint) as price, ", 1) + ", d as (select i*0.5e0 as d, i*5 as dt from (select unnest(range(1,120)) as i)), m as (select o1.sample_id, d, count(*) as events, count(o2.t) as matched from o1 join d on o1.t>=d.dt "
       "left join o2 on o2.sample_id=o1.sample_id and o2.t=o1.t-d.dt and o2.price=o1.price and o2.volume=o1.volume and o2.side=o1.side and o2.order_action=o1.order_action group by 1,2)",
       select="select sample_id, d, events, matched, r6(matched/cast(events as double)) as rate from m")
def price_match(e: Episodes):
    band = F.floor(F.col("price") / F.lit(float(PRICE_BAND))).cast("long").alias("price")
    a = e.order.df.select("sample_id", "s", band, "volume", "side", "order_action")
    b = a.withColumn("sample_id", F.col("sample_id") - 1)
    return round6_all(J.shift_match(a, b, "sample_id", "s", ["price", "volume", "side", "order_action"], SHIFTS, 0.1), "d")


STATE = [0.0, 60.0, 180.0, 300.0]


@check("j9_state_match", views="market",
       ctes="a as (select *, unnest([" + ", ".join(f"{d}e0" for d in STATE) + "]) as d from market), b as (select * replace (sample_id-1 as sample_id) from market), sp as (select sample_id, min(s) as lo, max(s) as hi from b group by 1), "
       "p as (select a.*, s+d as target from a join sp using (sample_id) where s+d between lo and hi), "
       "u as (select p.*, b.s as us, b.ask_volume_1 as ua, b.bid_volume_1 as ub from p asof left join b on p.sample_id=b.sample_id and p.target<=b.s), "
       "v as (select u.*, b.s as ds, b.ask_volume_1 as da, b.bid_volume_1 as db from u asof left join b on u.sample_id=b.sample_id and u.target>=b.s), "
       "w as (select sample_id, d, case when ds is not null and (us is null or target-ds<=us-target) then da=ask_volume_1 and db=bid_volume_1 else ua=ask_volume_1 and ub=bid_volume_1 end as same from v)",
       select="select sample_id, d, count(*) as rows, fcnt(same) as matched, r6(fcnt(same)/cast(count(*) as double)) as rate from w group by 1,2")
def state_match(e: Episodes):
    later = e.market.map(lambda df: df.withColumn("sample_id", F.col("sample_id") - 1))
    return round6_all(J.state_match(e.market, later, ["ask_volume_1", "bid_volume_1"], STATE), "d")


@check("j10_key_overlap", views="trade ord",
       ctes="a as (select distinct sample_id, r6(s) as s, r6(price) as price, volume, side from trade), b as (select distinct sample_id, r6(s) as s, r6(price) as price, volume, side from ord)",
       select="select a.sample_id, count(*) as keys, count(b.s) as shared from a left join b on a.sample_id=b.sample_id and a.s=b.s and a.price=b.price and a.volume=b.volume and a.side=b.side group by 1")
def key_overlap(e: Episodes):
    cut = lambda t: round6_all(t.df.select("sample_id", "s", "price", "volume", "side"), "volume")
    return J.key_overlap(cut(e.trade), cut(e.order), "sample_id", ["s", "price", "volume", "side"])


@check("j11_scale_lookup", views="market calendar", ctes=FILL, select="select sample_id, r6(greatest(coalesce(U_s,0.0015037e0),1e-9)) as U_s, r6(coalesce(mid0,1e0)) as mid0 from calendar left join sc using (sample_id)")
def scale_lookup(e: Episodes):
    scale = S.snapshot_index(e.market).select("sample_id", "U_s", "mid0")
    return round6_all(J.lookup(e.calendar, scale, "sample_id", {"U_s": S.TICK_FALLBACK["train"], "mid0": 1.0}, {"U_s": 1e-9}))


@check("j12_group_mean", views="trade", ctes="m as (select *, avg(volume) over (partition by sample_id) as vm from trade)", select="select sample_id, fcnt(volume>2*vm) as big, r6(max(volume-vm)) as above from m group by 1")
def group_mean(e: Episodes):
    df = with_group_values(e.trade, {"vm": F.avg("volume")})
    return round6_all(df.groupBy("sample_id").agg(A.fcnt(F.col("volume") > 2 * F.col("vm")).alias("big"), F.max(F.col("volume") - F.col("vm")).alias("above")))


@check("j13_complete_grid", views="trade calendar",
       ctes="c as (select sample_id, cast(59-floor(s) as int) as bin, count(*) as n, sum(volume) as v from trade group by 1,2), g as (select sample_id, cast(unnest(range(0,60)) as int) as bin from calendar)",
       select="select g.sample_id, g.bin, coalesce(n,0) as n, r6(coalesce(v,0e0)) as v from g left join c on g.sample_id=c.sample_id and g.bin=c.bin")
def complete_grid(e: Episodes):
    cells = e.trade.df.groupBy("sample_id", grid.bin_of_clock().alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v"))
    return round6_all(J.complete_grid(e.calendar, cells, "sample_id", "bin", grid.BINS))


# ---- aggregates ---------------------------------------------------------------------------------


@check("a1_many_aggregates", views="trade", select="select sample_id, count(*) as n, r6(sum(volume)) as v, r6(avg(price)) as p, r6(min(s)) as s0, r6(max(s)) as s1, r6(sum(price*volume)) as pv from trade group by 1")
def many(e: Episodes):
    return round6_all(e.trade.df.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v"), F.avg("price").alias("p"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.sum(F.col("price") * F.col("volume")).alias("pv")))


@check("a2_filtered_aggregates", views="trade", select="select sample_id, r6(fsum(volume, s<=1)) as v1, r6(favg(price, s<=1)) as p1, r6(fstd(price, s<=1)) as d1, fcnt(s<=1) as n1 from trade group by 1")
def filtered(e: Episodes):
    near = F.col("s") <= 1
    return round6_all(e.trade.df.groupBy("sample_id").agg(
        A.fsum("volume", near).alias("v1"), A.favg("price", near).alias("p1"), A.fstd("price", near).alias("d1"), A.fcnt(near).alias("n1")))


@check("a3_counts", views="ord", select="select sample_id, count(*) as n, count(distinct floor(s)) as seconds, fcnt(order_action=1) as cancels from ord group by 1")
def counts(e: Episodes):
    per = e.order.df.groupBy("sample_id", F.floor("s").alias("sec")).agg(F.count(F.lit(1)).alias("n"), A.fcnt(F.col("order_action") == 1).alias("c"))
    return per.groupBy("sample_id").agg(F.sum("n").alias("n"), F.count("sec").alias("seconds"), F.sum("c").alias("cancels"))


@check("a4_first_last", views="market",
       ctes="r as (select *, row_number() over (partition by sample_id order by s) as i, row_number() over (partition by sample_id order by s desc) as j from market)",
       select="select sample_id, r6(max(transaction_volume) filter (where i=1)) as newest, r6(max(transaction_volume) filter (where j=1)) as oldest, r6(max(s) filter (where j=1)) as s from r group by 1")
def first_last(e: Episodes):
    newest = e.market.df.groupBy("sample_id").agg(F.min_by("transaction_volume", "s").alias("newest"))
    old = oldest_row(e.market).select("sample_id", F.col("transaction_volume").alias("oldest"), "s")
    return round6_all(newest.join(old, "sample_id"))


@check("a5_moments", views="trade", select="select sample_id, r6(avg(price)) as m, r6(stddev_samp(price)) as sd, r6(min(price)) as lo, r6(max(price)) as hi from trade group by 1")
def moments(e: Episodes):
    return round6_all(e.trade.df.groupBy("sample_id").agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("sd"), F.min("price").alias("lo"), F.max("price").alias("hi")))


@check("a6_shape", views="trade", select="select sample_id, r6(skew(price)) as skew_pop, r6(skewness(price)) as skew_corrected, r6(kurtosis(price)) as kurt_corrected from trade group by 1")
def shape(e: Episodes):
    return round6_all(e.trade.df.groupBy("sample_id").agg(
        F.skewness("price").alias("skew_pop"), A.bias_corrected_skew("price").alias("skew_corrected"), A.bias_corrected_kurtosis("price").alias("kurt_corrected")))


NEAREST = "list_sort(list({c}))[cast(floor((count({c})-1)*{q}e0+0.5e0) as int)+1]"


@check("a7_median_quantile", views="trade", select="select sample_id, r6(quantile_cont(price,0.5)) as med, r6(" + NEAREST.format(c="price", q=0.25) + ") as q25, r6(quantile_cont(volume,0.9)) as q90 from trade group by 1")
def med_quantile(e: Episodes):
    specs = {"med": ("price", 0.5, "linear"), "q25": ("price", 0.25, "nearest"), "q90": ("volume", 0.9, "linear")}
    return round6_all(quantiles.quantiles(e.trade.df, ["sample_id"], specs, hot=e.trade.hot, limit=e.limit))


@check("a8_table_quantile", views="trade months",
       select="select -1 as month, r6(" + NEAREST.format(c="volume", q=0.9) + ") as q90, r6(" + NEAREST.format(c="volume", q=0.95) + ") as q95 from trade union all select month, r6("
       + NEAREST.format(c="volume", q=0.9) + "), r6(" + NEAREST.format(c="volume", q=0.95) + ") from trade join months using (sample_id) group by month")
def table_quantile(e: Episodes):
    whole = cross.size_thresholds(e.trade, None, e.hot_all_trades).select(F.lit(-1).alias("month"), "q90", "q95")
    return round6_all(whole.unionByName(cross.size_thresholds(e.trade, e.months, e.hot_month_trades)))


@check("a9_two_level", views="trade", ctes="c as (select sample_id, floor(s/5) as b, count(*) as n from trade group by 1,2)", select="select sample_id, r6(max(n)/cast(sum(n) as double)) as burst5 from c group by 1")
def two_level(e: Episodes):
    return round6_all(trade.per_second(e.trade, "t").select("sample_id", "burst5"))


@check("a10_decayed_mean", views="bk0", select="select sample_id, r6(sum(mid_v*ew(30))/sum(ew(30))) as m30, r6(sum(mid_v*ew(120))/sum(ew(120))) as m120 from bk0 group by 1")
def decayed(e: Episodes):
    df = book.with_book(e.market.df)
    return round6_all(df.groupBy("sample_id").agg(A.decayed_mean("mid_v", "s", 30).alias("m30"), A.decayed_mean("mid_v", "s", 120).alias("m120")))


@check("a11_vwap", views="trade", select="select sample_id, r6(div(sum(price*volume), sum(volume))) as vwap from trade group by 1")
def vwap(e: Episodes):
    return round6_all(e.trade.df.groupBy("sample_id").agg(A.vwap().alias("vwap")))


@check("a12_crosstab", views="ord", select="select side, fcnt(order_action=0) as order_action_0, fcnt(order_action=1) as order_action_1 from ord group by 1")
def crosstab(e: Episodes):
    return Q.crosstab(e.order.df, "side", "order_action", [0, 1])


@check("a12_value_counts", views="ord", select="select volume, count(*) as count from ord group by 1")
def value_counts(e: Episodes):
    return e.order.df.groupBy("volume").agg(F.count(F.lit(1)).alias("count"))


@check("a14_pearson", views="pred", ctes=PR, select="select month, r6(case when count(*)>=40 then corr(p_a,target) end) as corr from pr group by 1")
def pearson(e: Episodes):
    return round6_all(pr(e).groupBy("month").agg(A.pearson("p_a", "target", 40).alias("corr")))


@check("a15_cosine", views="pred", ctes=PR, select="select month, r6(cosine(p_a,target)) as cos from pr group by 1")
def cosine(e: Episodes):
    return round6_all(pr(e).groupBy("month").agg(A.cosine("p_a", "target").alias("cos")))


# ---- windows ------------------------------------------------------------------------------------

W = f"window w as (partition by sample_id order by s, {TIES})"


@check("w1_row_index", views="trade", select=f"select sample_id, {TIES}, row_number() over w - 1 as idx, count(*) over (partition by sample_id) - row_number() over w as back from trade {W}")
def row_index(e: Episodes):
    df = e.trade.ordered()
    return df.select("sample_id", *e.trade.ties, "idx", (F.col("n") - 1 - F.col("idx")).alias("back"))


@check("w2_nth_snapshot", views="bk", select="select sample_id, r6(max(mid) filter (where idx=0)) as m0, r6(max(mid) filter (where idx=19)) as m19, r6(max(mid) filter (where idx=39)) as m39, r6(max(mid) filter (where idx=n-1)) as m_old from bk group by 1")
def nth(e: Episodes):
    df = e.market.map(book.with_book).ordered()
    return round6_all(df.groupBy("sample_id").agg(book.value_at(0, "mid").alias("m0"), book.value_at(19, "mid").alias("m19"), book.value_at(39, "mid").alias("m39"), book.oldest_value("mid").alias("m_old")))


@check("w3_first_difference", views="bk", select="select sample_id, r6(s) as s, r6(dmid) as dmid, r6(dmid_v) as dmid_v from bk")
def first_difference(e: Episodes):
    return round6_all(book.rows(e.market).select("sample_id", "s", "dmid", "dmid_v"))


@check("w4_lagged_difference", views="tr", select=f"select sample_id, {TIES}, " + ", ".join(f"r6(dp{k}) as dp{k}" for k in (1, 7, 14, 21, 30)) + " from tr")
def lagged(e: Episodes):
    lags = {f"p{k}": ("price", k) for k in (1, 7, 14, 21, 30)}
    df = e.trade.ordered(lags=lags)
    return round6_all(df.select("sample_id", *e.trade.ties, *[(F.col("price") - F.col(f"p{k}")).alias(f"dp{k}") for k in (1, 7, 14, 21, 30)]))


@check("w5_event_gap", views="tr", select=f"select sample_id, {TIES}, r6(gap) as gap from tr")
def event_gap(e: Episodes):
    df = e.trade.ordered(lags={"prev": ("s", 1)})
    return round6_all(df.select("sample_id", *e.trade.ties, (F.col("s") - F.col("prev")).alias("gap")))


@check("w6_second_shift", views="trade", ctes="p as (select sample_id, cast(floor(s) as int) as sec, avg(price) as px from trade group by 1,2)",
       select="select sample_id, sec, r6(px) as px, r6(lag(px,1) over (partition by sample_id order by sec)) as px1, r6(lag(px,5) over (partition by sample_id order by sec)) as px5 from p")
def second_shift(e: Episodes):
    per = e.trade.df.groupBy("sample_id", F.floor("s").cast("int").alias("sec")).agg(F.avg("price").alias("px"))
    # at most 61 seconds per episode after the aggregation
    return round6_all(ordered(per, ["sample_id"], [F.col("sec").asc()], hot=None, idx=None, total=None, lags={"px1": ("px", 1), "px5": ("px", 5)}))


@check("w8_thirds", views="tr", select="select sample_id, fcnt(idx<n/2e0) as newer_half, fcnt(idx<n/3e0) as newest_third, fcnt(idx>=2*n/3e0) as oldest_third from tr group by 1")
def thirds(e: Episodes):
    half, third, last = trade.thirds()
    return e.trade.ordered().groupBy("sample_id").agg(A.fcnt(half).alias("newer_half"), A.fcnt(third).alias("newest_third"), A.fcnt(last).alias("oldest_third"))


# ---- sorts, limits, sets, scalars ---------------------------------------------------------------


@check("s1_episode_order", views="trade",
       ctes=f"r as (select *, row_number() over (partition by sample_id order by s, {TIES}) - 1 as idx from trade)",
       select="select sample_id, idx, r6(s) as s, volume from r")
def episode_order(e: Episodes):
    return round6_all(e.trade.ordered(total=None).select("sample_id", "idx", "s", "volume"), "volume")


@check("s2_stable_event_order", views="trade", select=f"select sample_id, {TIES}, row_number() over (partition by sample_id order by s desc, {TIES}) - 1 as pos from trade")
def stable_order(e: Episodes):
    return e.trade.ordered(newest=False, idx="pos", total=None).select("sample_id", *e.trade.ties, "pos")


@check("s4_top_k_features", views=FV, ctes=FACTORS + ", g as (select unnest(['t_imb','t_n','spread0','patience_diff']) as feature, unnest([avg(abs(t_imb)), avg(t_n), avg(spread0), avg(abs(patience_diff))]) as gain, unnest([0,1,2,3]) as ordinal from fx)",
       select="select feature, r6(gain) as gain, ordinal from (select * from g order by gain desc, feature limit 3)")
def top_k_features(e: Episodes):
    cols = ["t_imb", "t_n", "spread0", "patience_diff"]
    wide = fx(e).agg(*[F.avg(F.abs(c)).alias(c) for c in cols])
    gains = wide.unpivot([], cols, "feature", "gain")
    order = e.spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "feature string, ordinal int")
    return round6_all(top_k(gains, order, 3))


@check("so1_union", views="trade ord", select="select src, count(*) as rows, r6(sum(price)) as price from (select 'trade' as src, price from trade union all select 'order', price from ord) group by 1")
def union(e: Episodes):
    both = e.trade.df.select(F.lit("trade").alias("src"), "price").unionByName(e.order.df.select(F.lit("order").alias("src"), "price"))
    return round6_all(both.groupBy("src").agg(F.count(F.lit(1)).alias("rows"), F.sum("price").alias("price")))


@check("so2_intersect", views="trade ord", select="select count(*) as shared from (select sample_id, price, volume, side from trade intersect select sample_id, price, volume, side from ord)")
def intersect(e: Episodes):
    cols = ["sample_id", "price", "volume", "side"]
    return e.trade.df.select(cols).intersect(e.order.df.select(cols)).agg(F.count(F.lit(1)).alias("shared"))


@check("so4_ordered_distinct", views="trade", ctes=f"n as (select sample_id, volume, min(row_number) as first_at from (select *, row_number() over (partition by sample_id order by s, {TIES}) - 1 as row_number from trade) group by 1,2)",
       select="select sample_id, volume, first_at from n")
def ordered_distinct(e: Episodes):
    return e.trade.ordered(total=None).groupBy("sample_id", "volume").agg(F.min("idx").alias("first_at"))


@check("m1_elementwise", views="trade",
       select=f"select sample_id, {TIES}, r6(exp(-s/30e0)) as e30, r6(sqrt(price)) as root, r6(pow(price,2e0)) as square, r6(abs(price-2e0)) as dist, r6(ln(price)) as log, r6(ln(1+volume)) as log1, r6(sign(price-2e0)*1e0) as sgn, r6(floor(s)) as whole, r6(asinh(volume)) as ah from trade")
def elementwise(e: Episodes):
    p, v, s = F.col("price"), F.col("volume"), F.col("s")
    return round6_all(e.trade.df.select(
        "sample_id", *e.trade.ties, decay(s, 30).alias("e30"), F.sqrt(p).alias("root"), F.pow(p, F.lit(2.0)).alias("square"), F.abs(p - 2).alias("dist"),
        F.ln(p).alias("log"), F.log1p(v).alias("log1"), F.signum(p - 2).alias("sgn"), F.floor(s).cast("double").alias("whole"), F.asinh(v).alias("ah")))


@check("m2_buckets", views="trade", select="select cast(floor(s/5) as int) as b5, cast(floor(s) as int) as sec, greatest(least(59-cast(floor(s) as int),59),0) as bin, count(*) as n from trade group by 1,2,3")
def buckets(e: Episodes):
    s = F.col("s")
    return e.trade.df.groupBy(F.floor(s / 5).cast("int").alias("b5"), F.floor(s).cast("int").alias("sec"), grid.bin_of_clock(s).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@check("m3_rowwise_max", views="market", select="select sample_id, r6(s) as s, r6(greatest(transaction_volume, ask_volume_1, bid_volume_1)) as most from market")
def rowwise_max(e: Episodes):
    return round6_all(e.market.df.select("sample_id", "s", F.greatest("transaction_volume", "ask_volume_1", "bid_volume_1").alias("most")))


@check("m4_second_lists", views="trade",
       ctes="l as (select sample_id, list_sort(list_distinct(list(cast(floor(s) as int)))) as secs from trade group by 1)",
       select="select sample_id, cast(len(secs) as int) as n, cast(len(list_filter(secs, lambda x: x<=15)) as int) as near, secs[1] as first, secs[len(secs)] as last, (select max(b-a) from (select unnest(secs[1:len(secs)-1]) as a, unnest(secs[2:]) as b)) as jump from l")
def second_lists(e: Episodes):
    # whole seconds of a 60 s window: at most 61 distinct values per episode
    secs = e.trade.df.groupBy("sample_id", F.floor("s").cast("int").alias("sec")).agg(F.lit(1).alias("x"))
    lists = secs.groupBy("sample_id").agg(F.sort_array(F.collect_list("sec")).alias("secs"))
    jumps = F.zip_with(F.slice("secs", 2, F.size("secs")), F.slice("secs", 1, F.size("secs") - 1), lambda b, a: b - a)
    return lists.select("sample_id", F.size("secs").alias("n"), F.size(F.filter("secs", lambda x: x <= 15)).alias("near"),
                        F.element_at("secs", 1).alias("first"), F.element_at("secs", -1).alias("last"), F.array_max(jumps).alias("jump"))


@check("m6_rounded_keys", views="trade", select="select cast(round(s*10) as bigint) as t, count(*) as n from trade group by 1")
def rounded_keys(e: Episodes):
    return e.trade.df.groupBy(F.round(F.col("s") * 10).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))


@check("io9_distinct_labels", views="label", select="select count(*) as rows, count(distinct sample_id) as episodes, count(distinct month) as months from label")
def distinct_labels(e: Episodes):
    return e.label.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("episodes"), F.count_distinct("month").alias("months"))


@check("e9_signal_correlations", views="trade label", ctes="x as (select sample_id, imb(fsum(volume, side=0), fsum(volume, side=1)) as im, count(*) as n, r6(max(target)) as target from trade join label using (sample_id) group by 1)",
       select="select 'imbalance' as signal, r6(corr(im,target)) as corr, r6(corr(im,sign(target))) as corr_sign, r6(corr(im,abs(target))) as corr_abs from x union all select 'trades', r6(corr(n,target)), r6(corr(n,sign(target))), r6(corr(n,abs(target))) from x")
def signal_correlations(e: Episodes):
    buy = F.when(signed() > 0, F.col("volume")).otherwise(0.0)
    sell = F.when(signed() < 0, F.col("volume")).otherwise(0.0)
    x = e.trade.df.groupBy("sample_id").agg(imbalance(F.sum(buy), F.sum(sell)).alias("imbalance"), F.count(F.lit(1)).cast("double").alias("trades"))
    x = x.join(round6_all(e.label), "sample_id")
    t = F.col("target")
    row = lambda c: F.struct(F.lit(c).alias("signal"), A.pearson(c, t, 2).alias("corr"), A.pearson(c, F.signum(t), 2).alias("corr_sign"), A.pearson(c, F.abs(t), 2).alias("corr_abs"))
    wide = x.agg(row("imbalance").alias("a"), row("trades").alias("b"))
    return round6_all(wide.select(F.explode(F.array("a", "b")).alias("r")).select("r.*"))
