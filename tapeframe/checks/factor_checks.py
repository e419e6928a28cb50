"""The factor catalogue, family by family."""

from __future__ import annotations

from ..functions.scalars import round6_all
from ..plans import book, cross, names, order, trade
from ..sources.adapters import Episodes
from .registry import check


def rounded(defs: dict[str, str], whole: set[str] = frozenset()) -> str:
    return ", ".join(f"{e} as {c}" if c in whole else f"r6({e}) as {c}" for c, e in defs.items())


def at(i: int, x: str) -> str:
    return f"max({x}) filter (where idx={i})"


BUY, SELL = "fsum(volume, side=0)", "fsum(volume, side=1)"

# ---- trades -------------------------------------------------------------------------------------

BASE_TRADE = {
    "t_imb": f"imb({BUY}, {SELL})",
    "t_imb_w30": "imb(fsum(volume*ew(30), side=0), fsum(volume*ew(30), side=1))",
    "t_imb_w10": "imb(fsum(volume*ew(10), side=0), fsum(volume*ew(10), side=1))",
    "t_imb_2s": "imb(fsum(volume, side=0 and s<=2), fsum(volume, side=1 and s<=2))",
    "t_imb_5s": "imb(fsum(volume, side=0 and s<=5), fsum(volume, side=1 and s<=5))",
    "t_size_imb": f"imb(div({BUY}, fcnt(side=0 and volume>0)), div({SELL}, fcnt(side=1 and volume>0)))",
    "t_vol": "sum(volume)",
    "t_n": "count(*)",
    "sig_txn": "stddev_samp(dp1)",
    "last_gap": "min(s)",
    "accel": "case when fcnt(s<=15)>0 and fcnt(s>=45)>0 then imb(fcnt(s<=15), fcnt(s>=45)) end",
}


@check(
    "f_base_trade",
    views="tr",
    ctes="""b5 as (select sample_id, max(c)/cast(sum(c) as double) as burst from
      (select sample_id, floor(s/5) as b, count(*) as c from trade group by 1,2) group by 1),
    a as (select sample_id, """ + rounded(BASE_TRADE, {"t_n"}) + " from tr group by sample_id)",
    select="select a.*, r6(burst) as burst5 from a join b5 using (sample_id)",
)
def base_trade(e: Episodes):
    return round6_all(trade.factors(e.trade, [*BASE_TRADE, "burst5"]))


NF = {}
for p, kinds in (("t", ("price", "vol", "rc")), ("o", ("vol", "rc", "cancel"))):
    for w in (15, 30, 60):
        near, far = f"sec<={w}/2e0", f"sec>{w}/2e0 and sec<={w}"
        if "price" in kinds:
            NF[f"{p}_price_nf_{w}"] = f"div(favg(price, {near}), favg(price, {far}))-1"
        NF[f"{p}_vol_nf_{w}"] = f"div(fsum(volume, {near}), fsum(volume, {far}))"
        NF[f"{p}_rc_nf_{w}"] = f"div(fcnt({near}), fcnt({far}))"
        if "cancel" in kinds:
            NF[f"{p}_cancel_nf_{w}"] = f"div(fcnt(order_action=1 and {near}), fcnt(order_action=1 and {far}))"

EXT1_TRADE = {
    "t_buy_ratio": "avg(case when side=0 then 1e0 else 0e0 end)",
    "t_buy_ratio_15": "favg(case when side=0 then 1e0 else 0e0 end, sec<=15)",
    "t_n_15": "fcnt(sec<=15)",
    **{c: e for c, e in NF.items() if c.startswith("t_")},
}
SILENCE = """sl as (select sample_id, sec, sec - lag(sec) over (partition by sample_id order by sec) - 1 as gp
      from (select distinct sample_id, sec from {src}))"""


@check(
    "f_ext1_trade",
    views="tr",
    ctes=SILENCE.format(src="tr") + ", a as (select sample_id, " + rounded(EXT1_TRADE, {"t_n_15"}) + " from tr group by sample_id),"
    " g as (select sample_id, fcnt(sec<=15) as t_has_data_15, cast(greatest(min(sec), 60-max(sec), coalesce(max(gp),0)) as bigint) as t_miss_max from sl group by 1)",
    select="select * from a join g using (sample_id)",
)
def ext1_trade(e: Episodes):
    return round6_all(trade.factors(e.trade, [*EXT1_TRADE, "t_has_data_15", "t_miss_max"]))


# nearest rank: the value at position (n-1)q rounded half up
RANKED = """nv as (select {key}, volume, row_number() over (partition by {key} order by volume) - 1 as r,
        count(*) over (partition by {key}) as n from {src}),
    th as (select {key}, max(volume) filter (where r=floor((n-1)*0.9e0+0.5e0)) as q90,
        max(volume) filter (where r=floor((n-1)*0.95e0+0.5e0)) as q95 from nv group by {key})"""

LARGE = {
    "t_large_buy": "fcnt(side=0 and volume>q90)",
    "t_large_sell": "fcnt(side=1 and volume>q95)",
    "x_large_imb": "div(fcnt(side=0 and volume>q90) - fcnt(side=1 and volume>q95), fcnt(sec<=15)+1)",
    "t_large_buy_15": "fcnt(side=0 and volume>q90 and s<=15)",
    "t_large_sell_15": "fcnt(side=1 and volume>q95 and s<=15)",
    "x_large_imb_15": "div(fcnt(side=0 and volume>q90 and s<=15) - fcnt(side=1 and volume>q95 and s<=15), fcnt(s<=15)+1)",
}
LARGE_WHOLE = {c for c in LARGE if c.startswith("t_")}


@check(
    "f_large_trades_by_period",
    views="tr months",
    ctes=RANKED.format(key="month", src="trade join months using (sample_id)")
    + ", w as (select tr.*, q90, q95 from tr join months using (sample_id) join th using (month))",
    select="select sample_id, " + rounded(LARGE, LARGE_WHOLE) + " from w group by sample_id",
)
def large_by_period(e: Episodes):
    th = cross.size_thresholds(e.trade, e.months, e.hot_month_trades)
    return round6_all(trade.factors(cross.with_size_thresholds(e.trade, e.months, th), list(LARGE)))


@check(
    "f_large_trades_overall",
    views="tr",
    ctes=RANKED.format(key="g", src="(select 0 as g, volume from trade)") + ", w as (select tr.*, q90, q95 from tr cross join th)",
    select="select sample_id, " + rounded(LARGE, LARGE_WHOLE) + " from w group by sample_id",
)
def large_overall(e: Episodes):
    th = cross.size_thresholds(e.trade, None, e.hot_all_trades)
    return round6_all(trade.factors(cross.with_size_thresholds(e.trade, None, th), list(LARGE)))


HALF, HALF2 = "idx*2<n", "idx*2>=n"
BUYF = "case when side=0 then 1e0 else 0e0 end"
EXT2_TRADE = {
    "t_sd": "fsum(sgn*price*volume)",
    "t_sd_15": "fsum(sgn*price*volume, sec<=15)",
    "t_sd_45": "fsum(sgn*price*volume, sec<=45)",
    "t_px_std": "stddev_samp(price)",
    "t_px_skew": "skew(price)",
    "t_px_last": at(0, "price"),
    "t_lv_mean": "avg(ln(1+volume))",
    "t_gap_mean": "avg(gap)",
    "t_gap_std": "stddev_samp(gap)",
    "t_gap_max": "max(gap)",
    "t_gap_cv": "div(stddev_samp(gap), avg(gap))",
    "t_firsthalf_price": f"div(favg(price, {HALF}), favg(price, {HALF2}))-1",
    "t_firsthalf_buyratio": f"favg({BUYF}, {HALF}) - favg({BUYF}, {HALF2})",
    "t_firstthird_vol": "div(fsum(volume, idx<n/3e0), fsum(volume, idx>=2*n/3e0))",
    "t_firstlast_px": at(0, "price") + " - max(price) filter (where idx=n-1)",
    "x_t_signed_ratio": "avg(sgn)",
    "x_t_signed_w15_diff": "div(fsum(sgn*volume*ew(15), sec<=15), fsum(volume*ew(15), sec<=15)) - favg(sgn, sec<=15)",
    "t_pxdiff1_mean": "avg(dp1)",
    "t_pxdiff1_std": "stddev_samp(dp1)",
    "t_pxdiff7_mean": "avg(dp7)",
    "t_pxdiff7_std": "stddev_samp(dp7)",
    "t_voldiff1_mean": "avg(dv1)",
    "t_voldiff7_mean": "avg(dv7)",
    "t_vwap": "div(sum(price*volume), sum(volume))",
}


@check(
    "f_ext2_trade",
    views="tr",
    ctes="""ps as (select sample_id, sec, avg(price) as px from tr group by 1,2),
    pl as (select *, lag(px,1) over w as px1, lag(px,5) over w as px5, avg(px) over (partition by sample_id) as m
      from ps window w as (partition by sample_id order by sec)),
    ac as (select sample_id, div(fsum((px-m)*(px1-m)), sum((px-m)*(px-m))) as a1,
      div(fsum((px-m)*(px5-m)), sum((px-m)*(px-m))) as a5 from pl group by 1),
    a as (select sample_id, """ + rounded(EXT2_TRADE) + " from tr group by sample_id)",
    select="select a.*, r6(a1) as t_autocorr_lag1, r6(a5) as t_autocorr_lag5 from a join ac using (sample_id)",
)
def ext2_trade(e: Episodes):
    return round6_all(trade.factors(e.trade, [*EXT2_TRADE, "t_autocorr_lag1", "t_autocorr_lag5"]))


EXT3_TRADE = {
    "t_sv_5": "fsum(sgn*volume, s<=15)",
    "t_sv_60": "fsum(sgn*volume)",
    "x_t_sv_5_60": "div(fsum(sgn*volume, s<=15), fsum(sgn*volume))",
    "t_vol_5": "fsum(volume, s<=15)",
    "x_t_vol_5_60": "div(fsum(volume, s<=15), sum(volume))",
    "t_n_60": "count(*)",
    "x_tn_15_60": "div(fcnt(s<=15), count(*))",
    "t_sd_ewm45": "sum(sgn*price*volume*ew(45))",
    "t_buy_sell_vol_ratio": f"div({BUY}, {SELL}+1)",
    "t_pxdiff14_mean": "avg(dp14)",
    "t_pxdiff14_std": "stddev_samp(dp14)",
    "t_pxdiff21_std": "stddev_samp(dp21)",
    "t_pxdiff30_std": "stddev_samp(dp30)",
    "t_voldiff14_mean": "avg(dv14)",
    "t_voldiff21_mean": "avg(dv21)",
}
PEAK = "pk as (select sample_id, max(v) as v from (select sample_id, sec, sum(volume) as v from {src} where s<=30 group by 1,2) group by 1)"


@check(
    "f_ext3_trade",
    views="tr",
    ctes=PEAK.format(src="tr") + ", a as (select sample_id, " + rounded(EXT3_TRADE, {"t_n_60"}) + " from tr group by sample_id)",
    select="select a.*, r6(v) as t_vol_max30 from a left join pk using (sample_id)",
)
def ext3_trade(e: Episodes):
    return round6_all(trade.factors(e.trade, [*EXT3_TRADE, "t_vol_max30"]))


SCAN = {
    **{f"t_imb_{w}s": f"imb(fsum(volume, side=0 and s<={w}), fsum(volume, side=1 and s<={w}))" for w in (2, 5, 10, 15, 30, 60)},
    **{f"t_imb_w{t}": f"imb(fsum(volume*ew({t}), side=0), fsum(volume*ew({t}), side=1))" for t in (10, 20, 60)},
    "t_count_imb": "imb(fcnt(side=0), fcnt(side=1))",
}


@check("f_trade_window_scan", views="trade", select="select sample_id, " + rounded(SCAN) + " from trade group by sample_id")
def window_scan(e: Episodes):
    exprs = trade.window_imbalances()
    return round6_all(e.trade.df.groupBy("sample_id").agg(*[x.alias(c) for c, x in exprs.items()]))


# ---- orders -------------------------------------------------------------------------------------

BASE_ORDER = {
    "ofi": "sum(flow)",
    "ofi_w30": "sum(flow*ew(30))",
    "ofi_w10": "sum(flow*ew(10))",
    "ofi_norm": "div(sum(flow), sum(volume))",
    "ofi_w30_norm": "div(sum(flow*ew(30)), sum(volume*ew(30)))",
    "ofi_w10_norm": "div(sum(flow*ew(10)), sum(volume*ew(10)))",
    "ofi_5s": "sum(flow) filter (where s<=5)",
    "o_vol": "sum(volume)",
    "o_n": "count(*)",
    "cancel_imb": "imb(fsum(volume, side=0 and order_action=1), fsum(volume, side=1 and order_action=1))",
    "patience_diff": "imb(fsum(volume, side=0 and order_action=0), fsum(volume, side=0 and order_action=1))"
    " - imb(fsum(volume, side=1 and order_action=0), fsum(volume, side=1 and order_action=1))",
}


@check("f_base_order", views="orr", select="select sample_id, " + rounded(BASE_ORDER, {"o_n"}) + " from orr group by sample_id")
def base_order(e: Episodes):
    return round6_all(order.factors(e.order, list(BASE_ORDER)))


EXT1_ORDER = {
    "o_buy_ratio": f"avg({BUYF})",
    "o_buy_ratio_15": f"favg({BUYF}, sec<=15)",
    **{c: x for c, x in NF.items() if c.startswith("o_")},
}


@check(
    "f_ext1_order",
    views="orr",
    ctes=SILENCE.format(src="orr") + ", a as (select sample_id, " + rounded(EXT1_ORDER) + " from orr group by sample_id),"
    " g as (select sample_id, fcnt(sec<=15) as o_has_data_15, cast(greatest(min(sec), 60-max(sec), coalesce(max(gp),0)) as bigint) as o_miss_max from sl group by 1)",
    select="select * from a join g using (sample_id)",
)
def ext1_order(e: Episodes):
    return round6_all(order.factors(e.order, [*EXT1_ORDER, "o_has_data_15", "o_miss_max"]))


EXT23_ORDER = {
    "o_px_std": "stddev_samp(price)",
    "o_px_skew": "skew(price)",
    "o_bid_depth": BUY,
    "o_ask_depth": SELL,
    "o_sv": "sum(sgn*volume)",
    "o_av": "sum(act*volume)",
    "o_gap_mean": "avg(gap)",
    "o_gap_std": "stddev_samp(gap)",
    "o_gap_cv": "div(stddev_samp(gap), avg(gap))",
    "o_cancel_new_ratio": "div(fcnt(order_action=1), fcnt(order_action=0)+1)",
    "o_firsthalf_price": f"div(favg(price, {HALF}), favg(price, {HALF2}))-1",
    "o_firstthird_vol": "div(fsum(volume, idx<n/3e0), fsum(volume, idx>=2*n/3e0))",
    "o_pxdiff1_mean": "avg(dp1)",
    "o_pxdiff1_std": "stddev_samp(dp1)",
    "o_pxdiff7_std": "stddev_samp(dp7)",
    "o_voldiff1_mean": "avg(dv1)",
    "o_sv_ewm15": "sum(sgn*volume*ew(15))",
    "o_av_ewm45": "sum(act*volume*ew(45))",
    "o_add_ratio": "avg(case when order_action=0 then 1e0 else 0e0 end)",
    "o_pxdiff14_std": "stddev_samp(dp14)",
    "o_voldiff14_mean": "avg(dv14)",
}


@check(
    "f_ext2_ext3_order",
    views="orr",
    ctes=PEAK.format(src="orr") + ", a as (select sample_id, " + rounded(EXT23_ORDER) + " from orr group by sample_id)",
    select="select a.*, r6(v) as o_vol_max30 from a left join pk using (sample_id)",
)
def ext23_order(e: Episodes):
    return round6_all(order.factors(e.order, [*EXT23_ORDER, "o_vol_max30"]))


# ---- book ---------------------------------------------------------------------------------------

TILT = "imb(bid_volume_1, ask_volume_1)"
SP60, V60, V600 = "favg(spread, idx<20)", "fstd(dmid, idx<20)", "stddev_samp(dmid)"
UP, DOWN = "fstd(dmid, idx<20 and dmid>0)", "fstd(dmid, idx<20 and dmid<0)"
OLDEST = "max(mid) filter (where idx=n-1)"
D0, D60 = at(0, "ask_volume_1+bid_volume_1"), at(19, "ask_volume_1+bid_volume_1")
BASE_BOOK = {
    "mid": at(0, "mid"),
    "micro": at(0, "micro"),
    "mid60": at(19, "mid"),
    "micro60": at(19, "micro"),
    "mid600": OLDEST,
    "d60_mid": f"{at(0, 'mid')} - {at(19, 'mid')}",
    "d600_mid": f"{at(0, 'mid')} - {OLDEST}",
    "d60_micro": f"{at(0, 'micro')} - {at(19, 'micro')}",
    "book_imb0": at(0, TILT),
    "book_imb60": at(19, TILT),
    "d_book_imb": f"{at(0, TILT)} - {at(19, TILT)}",
    "spread0": at(0, "spread"),
    "spread_mean60": SP60,
    "mid_vol60": V60,
    "mid_vol600": V600,
    "range_pos": f"case when max(mid)>min(mid) then ({at(0, 'mid')} - min(mid))/(max(mid)-min(mid)) end",
    "curv": f"{at(0, 'mid')} - 2*{at(19, 'mid')} + {at(39, 'mid')}",
    "vol_skew": f"case when {UP}>0 and {DOWN}>0 then {UP}/{DOWN} end",
    "spread_sqz": f"div({at(0, 'spread')} - {SP60}, {SP60})",
    "depth_flow": f"imb({D0}, {D60})",
    "vol_ratio": f"case when {V600}>0 then {V60}/{V600} end",
    "micro_imb0": f"{at(0, 'micro')} - {at(0, 'mid')}",
    "micro_imb60": f"{at(19, 'micro')} - {at(19, 'mid')}",
}


@check("f_base_book", views="bk", select="select sample_id, " + rounded(BASE_BOOK) + " from bk group by sample_id")
def base_book(e: Episodes):
    return round6_all(book.factors(e.market, list(BASE_BOOK)))


ALL4 = "(bid_volume_1+bid_volume_2+ask_volume_1+ask_volume_2)"
LEVEL2 = "ask_price_2>0 and bid_price_2>0 and mid>0"
ASK_SLOPE = "favg(case when ask_volume_2<>ask_volume_1 then (ask_price_2-ask_price_1)/(ask_volume_2-ask_volume_1) end, valid and s<=60)"
BID_SLOPE = "favg(case when bid_volume_1<>bid_volume_2 then (bid_price_1-bid_price_2)/(bid_volume_1-bid_volume_2) end, valid and s<=60)"
RV60, RV600 = "sqrt(fsum(dmid_v*dmid_v, s<=60))", "sqrt(sum(dmid_v*dmid_v))"
EXT1_BOOK = {
    "rel_spread2_0": at(0, f"case when {LEVEL2} then (ask_price_2-bid_price_2)/mid end"),
    "imb2_0": at(0, f"case when {ALL4}>0 then (bid_volume_1+bid_volume_2-ask_volume_1-ask_volume_2)/{ALL4} end"),
    "slope_0": at(0, f"case when {LEVEL2} then ((ask_price_2-ask_price_1)+(bid_price_1-bid_price_2))/mid end"),
    "ask_slope_mean60": ASK_SLOPE,
    "bid_slope_mean60": BID_SLOPE,
    "slope_imb60": f"{BID_SLOPE} - {ASK_SLOPE}",
    "m_rv60": RV60,
    "m_rv600": RV600,
    "x_rv_60_600": f"case when {RV600}>0 then {RV60}/{RV600} end",
}


@check("f_ext1_book", views="bk", select="select sample_id, " + rounded(EXT1_BOOK) + " from bk group by sample_id")
def ext1_book(e: Episodes):
    return round6_all(book.factors(e.market, list(EXT1_BOOK)))


def ewm(x: str, t: int) -> str:
    return f"(fsum(({x})*ew({t}))/sum(ew({t})))"


LAST_V = at(0, "mid_v")
EXT2_BOOK = {
    "m_mid_last": LAST_V,
    "m_mid_mean": "avg(mid_v)",
    "m_mid_std": "stddev_samp(mid_v)",
    "m_mid_skew": "skew(mid_v)",
    "m_sp_mean": "avg(spread_v)",
    "m_sp_std": "stddev_samp(spread_v)",
    "m_imb_mean": "avg(imbal)",
    "m_imb_std": "stddev_samp(imbal)",
    "m_imb2_mean60": "favg(imbal*imbal, s<=60)",
    "m_dofi": "sum(dofi)",
    "m_dofi_60": "fsum(dofi, s<=60)",
    "m_dofi_ewm120": ewm("dofi", 120),
    "m_mid_ewm30": ewm("mid_v", 30),
    "m_mid_ewm120": ewm("mid_v", 120),
    "m_imb_ewm30": ewm("imbal", 30),
    "m_imb_ewm120": ewm("imbal", 120),
    "x_imb_ewm_sl": f"{ewm('imbal', 30)} - {ewm('imbal', 120)}",
    "x_dofi_ewm_sl": f"{ewm('dofi', 30)} - {ewm('dofi', 120)}",
    "x_mid_zscore": f"({LAST_V} - avg(mid_v))/(stddev_samp(mid_v)+1e-12)",
    "x_sp_imb": "avg(spread_v)*avg(imbal)",
}


@check("f_ext2_book", views="bk", select="select sample_id, " + rounded(EXT2_BOOK) + " from bk group by sample_id")
def ext2_book(e: Episodes):
    return round6_all(book.factors(e.market, list(EXT2_BOOK)))


def edge(w: int) -> str:
    return f"arg_max_null(mid_v, s) filter (where s<={w})"


EXT3_BOOK = {
    "m_dofi2_sum60": "fsum(dofi*dofi, s<=60)",
    "m_dofi2_ewm120": ewm("dofi*dofi", 120),
    "m_imb_med": "quantile_cont(imbal, 0.5)",
    "m_imb_q25": "list_sort(list(imbal) filter (where imbal is not null))[cast(floor((count(imbal)-1)*0.25e0+0.5e0) as int)+1]",
    "m_sp_q75": "list_sort(list(spread_v) filter (where spread_v is not null))[cast(floor((count(spread_v)-1)*0.75e0+0.5e0) as int)+1]",
    "m_mid_ret_abs_mean60": "favg(abs(dmid_v), s<=60)",
    "m_mid_slope_180": f"({LAST_V} - {edge(180)})/180",
    "m_mid_slope_60": f"({LAST_V} - {edge(60)})/60",
    "m_imb_mean_15": "favg(imbal, s<=15)",
    "x_imb_15_180": "favg(imbal, s<=15) - favg(imbal, s<=180)",
    "m_txv_std30": "fstd(coalesce(transaction_volume,0), s<=30)",
    "m_ask_gap_mean60": "favg(ask_price_2-ask_price_1, valid and ask_price_2>0 and s<=60)",
    "m_bid_gap_mean60": "favg(bid_price_1-bid_price_2, valid and bid_price_2>0 and s<=60)",
}


@check("f_ext3_book", views="bk", select="select sample_id, " + rounded(EXT3_BOOK) + " from bk group by sample_id")
def ext3_book(e: Episodes):
    return round6_all(book.factors(e.market, list(EXT3_BOOK)))


# ---- across tables ------------------------------------------------------------------------------

ASOF = """j as (select t.sample_id, t.s, t.price, t.volume, t.side, m.ask_price_1, m.bid_price_1,
      m.ask_volume_1+m.bid_volume_1 as depth, m.s as matched_at
    from trade t asof left join market m on t.sample_id=m.sample_id and t.s<=m.s),
    jj as (select *, case when side=0 then volume else -volume end as sv,
      case when price>ask_price_1 or price<bid_price_1 then 1e0 else 0e0 end as crossed from j)"""


@check(
    "f_base_depth",
    views="trade market",
    ctes=ASOF,
    select="""select sample_id,
      r6(case when fcnt(depth=0)=0 then fsum(sv/depth) end) as imp_depth_60,
      r6(case when fcnt(depth=0 and s<=5)=0 then fsum(sv/depth, s<=5) end) as imp_depth_5,
      r6(avg(crossed)) as spread_cross_frac, r6(div(sum(sv*crossed), sum(volume*crossed))) as aggr_imb
    from jj group by sample_id""",
)
def base_depth(e: Episodes):
    return round6_all(cross.depth_impact(e.trade, e.market))


CROSS = {
    "vwap_dev60": "mid0 - t_vwap",
    "vwap_dev600": "mid0 - vwap600",
    "x_to_buy_diff": "t_br - o_br",
    "x_to_buy_diff_15": "t_br15 - o_br15",
    "x_vwap_mid_ratio": "div(t_vwap - mid_last, mid_last)",
    "x_trans_order_vol_ratio": "div(t_vol, o_vol)",
}
CROSS_CTES = f"""b as (select sample_id, {at(0, "mid")} as mid0, {LAST_V} as mid_last,
      div(sum(transaction_avgprice*transaction_volume), sum(transaction_volume)) as vwap600 from bk group by 1),
    t as (select sample_id, div(sum(price*volume), sum(volume)) as t_vwap, sum(volume) as t_vol, avg({BUYF}) as t_br,
      favg({BUYF}, floor(s)<=15) as t_br15 from trade group by 1),
    o as (select sample_id, sum(volume) as o_vol, avg({BUYF}) as o_br, favg({BUYF}, floor(s)<=15) as o_br15 from ord group by 1)"""


@check(
    "f_cross_table",
    views="bk trade ord",
    ctes=CROSS_CTES,
    select="select b.sample_id, " + rounded(CROSS) + " from b left join t using (sample_id) left join o using (sample_id)",
)
def cross_table(e: Episodes):
    return round6_all(cross.catalogue(e.market, e.order, e.trade, list(CROSS)))


PAIR_INPUTS = {
    "t_imb_w10": ("tr", BASE_TRADE), "t_imb_2s": ("tr", BASE_TRADE), "t_vol": ("tr", BASE_TRADE), "t_n": ("tr", BASE_TRADE),
    "t_sd_15": ("tr", EXT2_TRADE), "ofi_w10": ("orr", BASE_ORDER), "m_mid_std": ("bk", EXT2_BOOK), "m_rv600": ("bk", EXT1_BOOK),
    "m_rv60": ("bk", EXT1_BOOK), "m_dofi_ewm120": ("bk", EXT2_BOOK), "m_imb_mean": ("bk", EXT2_BOOK),
    "m_sp_std": ("bk", EXT2_BOOK), "m_sp_mean": ("bk", EXT2_BOOK), "d_book_imb": ("bk", BASE_BOOK),
}


def raw(src: str, cols, extra: str = "") -> str:
    picked = ", ".join(f"{PAIR_INPUTS[c][1][c]} as {c}" for c in cols if PAIR_INPUTS[c][0] == src)
    return f"(select sample_id, {picked}{extra} from {src} group by sample_id)"


@check(
    "f_pair_products",
    views="tr orr bk",
    ctes=f"""b as {raw("bk", PAIR_INPUTS)}, t as {raw("tr", PAIR_INPUTS, f", favg({BUYF}, sec<=15) as t_br15")},
      o as {raw("orr", PAIR_INPUTS, f", favg({BUYF}, sec<=15) as o_br15")},
      j as (select *, t_br15 - o_br15 as x_to_buy_diff_15 from b left join t using (sample_id) left join o using (sample_id))""",
    select="select sample_id, " + ", ".join(f"r6({a}*{b}) as xp_{a}__{b}" for a, b in names.PAIRS) + " from j",
)
def pair_products(e: Episodes):
    return round6_all(cross.catalogue(e.market, e.order, e.trade, names.PAIR_NAMES))


SCALED = ("t_imb", "ofi", "ofi_norm", "t_imb_w30", "t_imb_2s")
BY_SPREAD = ("t_imb_2s", "t_imb_5s", "t_imb_w10", "ofi_w10_norm")
SCALED_TRADE = [c for c in (*SCALED, *BY_SPREAD) if c in BASE_TRADE]
SCALED_ORDER = [c for c in (*SCALED, *BY_SPREAD) if c in BASE_ORDER]


@check(
    "f_scaled_imbalances",
    views="tr orr bk",
    ctes="t as (select sample_id, " + ", ".join(f"{BASE_TRADE[c]} as {c}" for c in dict.fromkeys([*SCALED_TRADE, "sig_txn"])) + " from tr group by 1),"
    " o as (select sample_id, " + ", ".join(f"{BASE_ORDER[c]} as {c}" for c in SCALED_ORDER) + " from orr group by 1),"
    f" b as (select sample_id, {V60} as mid_vol60, {at(0, 'spread')} as spread0 from bk group by 1)",
    select="select sample_id, "
    + ", ".join(f"r6({c}*sig_txn) as {c}_x_sig, r6({c}*mid_vol60) as {c}_x_mv60" for c in SCALED)
    + ", " + ", ".join(f"r6(div({c}, spread0)) as {c}_div_spread" for c in BY_SPREAD)
    + " from b left join t using (sample_id) left join o using (sample_id)",
)
def scaled(e: Episodes):
    need = list(dict.fromkeys([*SCALED, *BY_SPREAD, "sig_txn", "mid_vol60", "spread0"]))
    df = cross.catalogue(e.market, e.order, e.trade, need)
    df = cross.with_spread_ratios(cross.with_volatility_products(df))
    made = [f"{c}{x}" for c in SCALED for x in ("_x_sig", "_x_mv60")] + [f"{c}_div_spread" for c in BY_SPREAD]
    return round6_all(df.select("sample_id", *made))


# ---- the whole catalogue ------------------------------------------------------------------------


def full_catalogue(e: Episodes, wanted=tuple(names.ALL)):
    th = cross.size_thresholds(e.trade, e.months, e.hot_month_trades)
    return cross.catalogue(e.market, e.order, e.trade, wanted, sizes=cross.episode_thresholds(e.trade, e.months, th))


CATALOGUE = (
    ASOF + ", " + CROSS_CTES.replace("b as (", "cb as (", 1).replace("\n    t as (", "\n    ct as (").replace("\n    o as (", "\n    co as (")
    + ", " + RANKED.format(key="month", src="trade join months using (sample_id)")
    + ", w as (select tr.*, q90, q95 from tr join months using (sample_id) join th using (month))"
    + ", fb as (select sample_id, " + rounded({**BASE_BOOK, **EXT1_BOOK, **EXT2_BOOK, **EXT3_BOOK}) + " from bk group by sample_id)"
    + ", ft as (select sample_id, " + rounded({**BASE_TRADE, **EXT1_TRADE, **LARGE, **EXT2_TRADE, **EXT3_TRADE}, {"t_n", "t_n_15", "t_n_60", *LARGE_WHOLE}) + " from w group by sample_id)"
    + ", fo as (select sample_id, " + rounded({**BASE_ORDER, **EXT1_ORDER, **EXT23_ORDER}, {"o_n"}) + " from orr group by sample_id)"
    + ", " + SILENCE.format(src="tr").replace("sl as", "slt as") + ", " + SILENCE.format(src="orr").replace("sl as", "slo as")
    + ", gt as (select sample_id, fcnt(sec<=15) as t_has_data_15, cast(greatest(min(sec), 60-max(sec), coalesce(max(gp),0)) as bigint) as t_miss_max from slt group by 1)"
    + ", go as (select sample_id, fcnt(sec<=15) as o_has_data_15, cast(greatest(min(sec), 60-max(sec), coalesce(max(gp),0)) as bigint) as o_miss_max from slo group by 1)"
    + ", " + PEAK.format(src="tr").replace("pk as", "pkt as") + ", " + PEAK.format(src="orr").replace("pk as", "pko as")
    + """, ps as (select sample_id, sec, avg(price) as px from tr group by 1,2),
    pl as (select *, lag(px,1) over w as px1, lag(px,5) over w as px5, avg(px) over (partition by sample_id) as m
      from ps window w as (partition by sample_id order by sec)),
    ac as (select sample_id, r6(div(fsum((px-m)*(px1-m)), sum((px-m)*(px-m)))) as t_autocorr_lag1,
      r6(div(fsum((px-m)*(px5-m)), sum((px-m)*(px-m)))) as t_autocorr_lag5 from pl group by 1),
    b5 as (select sample_id, r6(max(c)/cast(sum(c) as double)) as burst5 from
      (select sample_id, floor(s/5) as b, count(*) as c from trade group by 1,2) group by 1),
    di as (select sample_id, r6(case when fcnt(depth=0)=0 then fsum(sv/depth) end) as imp_depth_60,
      r6(case when fcnt(depth=0 and s<=5)=0 then fsum(sv/depth, s<=5) end) as imp_depth_5,
      r6(avg(crossed)) as spread_cross_frac, r6(div(sum(sv*crossed), sum(volume*crossed))) as aggr_imb from jj group by sample_id),
    cr as (select cb.sample_id, """ + rounded(CROSS) + """ from cb left join ct using (sample_id) left join co using (sample_id)),
    pb as """ + raw("bk", PAIR_INPUTS) + ", pt as " + raw("tr", PAIR_INPUTS, f", favg({BUYF}, sec<=15) as t_br15")
    + ", po as " + raw("orr", PAIR_INPUTS, f", favg({BUYF}, sec<=15) as o_br15")
    + ", pj as (select *, t_br15 - o_br15 as x_to_buy_diff_15 from pb left join pt using (sample_id) left join po using (sample_id))"
    + ", pp as (select sample_id, " + ", ".join(f"r6({a}*{b}) as xp_{a}__{b}" for a, b in names.PAIRS) + " from pj)"
)


def catalogue_sql(columns) -> str:
    peaks = {"t_vol_max30": "r6(pkt.v) as t_vol_max30", "o_vol_max30": "r6(pko.v) as o_vol_max30"}
    return (
        "select sample_id, "
        + ", ".join(peaks.get(c, c) for c in columns)
        + """ from fb left join ft using (sample_id) left join fo using (sample_id) left join gt using (sample_id)
      left join go using (sample_id) left join pkt using (sample_id) left join pko using (sample_id)
      left join ac using (sample_id) left join b5 using (sample_id) left join di using (sample_id)
      left join cr using (sample_id) left join pp using (sample_id)"""
    )


@check("f_catalogue_196", views="tr orr bk months", ctes=CATALOGUE, select=catalogue_sql(names.ALL))
def catalogue_196(e: Episodes):
    return round6_all(full_catalogue(e))


@check("f_base_47", views="tr orr bk months", ctes=CATALOGUE, select=catalogue_sql(names.BASE))
def base_47(e: Episodes):
    return round6_all(cross.catalogue(e.market, e.order, e.trade, names.BASE))
