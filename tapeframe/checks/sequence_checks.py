"""Grids, sequences and the ordered windows they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round6_all
from ..operators import grid, sequences as S, slots
from ..sources.adapters import Episodes
from .registry import check
from .sql import TIES

# ---- snapshot sequence --------------------------------------------------------------------------

BOOK = S.BOOK
VALID = "ask_price_1>0 and bid_price_1>0"
OLD = "partition by sample_id order by s desc"
FILL = f"""v as (select *, {VALID} as ok, row_number() over ({OLD}) - 1 as pos, count(*) over (partition by sample_id) as n,
      lag(s) over ({OLD}) as prev_s, {", ".join(f"case when {VALID} then {c} end as v_{c}" for c in BOOK)} from market),
    g as (select *, count(case when ok then 1 end) over ({OLD}) as grp from v),
    h as (select sample_id, {", ".join(f"arg_max(v_{c}, s) as h_{c}" for c in BOOK)} from v where ok group by 1),
    fl as (select g.sample_id, g.s, g.pos, g.n, g.ok, g.prev_s, g.transaction_volume, g.transaction_avgprice,
      {", ".join(f"coalesce(first_value(v_{c}) over (partition by g.sample_id, grp order by g.s desc), h_{c}, {1 if 'price' in c else 0}e0) as {c}" for c in BOOK)}
      from g left join h using (sample_id)),
    bs as (select *, (ask_price_1+bid_price_1)/2 as mid, ask_price_1-bid_price_1 as spread,
      ask_volume_1+bid_volume_1+ask_volume_2+bid_volume_2 as depth, ask_volume_1+bid_volume_1 as d1,
      coalesce(transaction_volume,0e0) as txn_vol, coalesce(transaction_avgprice,0e0) as txn_px from fl),
    b2 as (select *, case when d1>0 then (ask_price_1*bid_volume_1+bid_price_1*ask_volume_1)/d1 else mid end as micro,
      lag(mid) over ({OLD}) as m1 from bs),
    sc as (select sample_id, count(*) as n_valid, coalesce(quantile_cont(case when ok and spread>0 then spread end, 0.5), 0.0015037e0) as U_s,
      max(mid) filter (where pos=0) as mid0, quantile_cont(depth, 0.5) as med_depth, avg(txn_vol) as mean_vol from bs group by 1)"""
FILLED = "select sample_id, r6(s) as s, pos, " + ", ".join(f"r6({c}) as {c}" for c in BOOK) + " from fl"


def clipped(x: str, lo: float, hi: float) -> str:
    return f"greatest(least({x}, {hi}e0), {lo}e0)"


SNAP = {
    "mid_dev": clipped("(mid-mid0)/U_s", -256, 256),
    "dmid": "coalesce(mid-m1,0e0)/U_s",
    "spread_n": "spread/U_s",
    "book_imb": "case when d1>0 then (bid_volume_1-ask_volume_1)/d1 else 0e0 end",
    "micro_off": "(micro-mid)/U_s",
    "d_imb2": "case when depth>0 then (bid_volume_1+bid_volume_2-ask_volume_1-ask_volume_2)/depth else 0e0 end",
    "depth_rel": "case when med_depth>0 then (depth-med_depth)/med_depth else 0e0 end",
    "t_svol": "asinh(sign(txn_px-mid)*txn_vol)",
    "t_vol_rel": "txn_vol/(mean_vol+0.5e0)",
    "dpx": "case when txn_vol>0 then (txn_px-mid)/U_s else 0e0 end",
    "has_txn": "case when txn_vol>0 then 1e0 else 0e0 end",
    "tvol_dep": "asinh(txn_vol/(d1+1e0))",
    "eside": "case when ok then 0e0 else 1e0 end",
    "rel_t": clipped("(600e0-s)/600e0", 0, 1),
    "dt": f"coalesce({clipped('prev_s-s', 0, 30)}/30e0, 1e0)",
}


@check("w7_fill", views="market", ctes=FILL, select=FILLED)
def fill(e: Episodes):
    return round6_all(S.filled_book(e.market).df.select("sample_id", "s", "pos", *BOOK))


@check(
    "q1_snapshot_sequence",
    views="market",
    ctes=FILL,
    select="select sample_id, pos, n, " + ", ".join(f"r6({x}) as {c}" for c, x in SNAP.items()) + " from b2 join sc using (sample_id)",
)
def snapshot_sequence(e: Episodes):
    return round6_all(S.snapshot_sequence(e.market))


@check(
    "q2_scale_constants",
    views="market",
    ctes=FILL,
    select="select sample_id, n_valid, r6(U_s) as U_s, r6(mid0) as mid0, r6(med_depth) as med_depth, r6(mean_vol) as mean_vol from sc",
)
def scale(e: Episodes):
    return round6_all(S.snapshot_index(e.market))


CROP = 48


@check(
    "q9_newest_crop",
    views="market",
    ctes=FILL + f""", sq as (select sample_id, pos, n, {SNAP["mid_dev"]} as mid_dev, {SNAP["dt"]} as dt from b2 join sc using (sample_id)),
      slots as (select distinct sample_id, n, unnest(range(0,{CROP})) as slot from sq)""",
    select=f"""select slots.sample_id, slots.slot, sq.pos is not null as ok, r6(coalesce(mid_dev,0e0)) as mid_dev, r6(coalesce(dt,0e0)) as dt
      from slots left join sq on sq.sample_id=slots.sample_id and sq.pos = slots.n-{CROP}+slots.slot""",
)
def newest_crop(e: Episodes):
    arrays = S.newest_array(S.snapshot_sequence(e.market), ["mid_dev", "dt"], CROP)
    cells = arrays.select("sample_id", F.posexplode(F.arrays_zip("x", "mask")).alias("slot", "c"))
    cells = cells.select("sample_id", F.col("slot").cast("long").alias("slot"), F.col("c.mask").alias("ok"), F.col("c.x")[0].alias("mid_dev"), F.col("c.x")[1].alias("dt"))
    return round6_all(cells)


@check(
    "q9_full_pad",
    views="market",
    ctes=FILL,
    select=f"""select sample_id, cast({S.MAX_SNAPSHOTS} as bigint) as slots, cast(max(n) as bigint) as filled, r6(sum({SNAP["dt"]})) as dt_sum,
      r6(max({SNAP["spread_n"]}) filter (where pos=0)) as first_spread from b2 join sc using (sample_id) group by sample_id""",
)
def full_pad(e: Episodes):
    a = S.newest_array(S.snapshot_sequence(e.market), ["dt", "spread_n"], S.MAX_SNAPSHOTS)
    total = F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r[0])
    return round6_all(
        a.select(
            "sample_id", F.size("x").cast("long").alias("slots"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("filled"),
            total.alias("dt_sum"), F.col("x")[0][1].alias("first_spread"),
        )
    )


@check(
    "f11_zeroed_channels",
    views="market",
    ctes=FILL,
    select=f"""select sample_id, pos, n, r6({SNAP["mid_dev"]}) as mid_dev, 0e0 as dmid, r6({SNAP["spread_n"]}) as spread_n
      from b2 join sc using (sample_id)""",
)
def zeroed(e: Episodes):
    df = S.zero_channels(S.snapshot_sequence(e.market), ["dmid"])
    return round6_all(df.select("sample_id", "pos", "n", "mid_dev", "dmid", "spread_n"))


# ---- event sequences ----------------------------------------------------------------------------


def event_sql(src: str, action: bool) -> tuple[str, str]:
    act = "cast(order_action as double) as action, " if action else ""
    ctes = FILL + f""", ev as (select t.*, row_number() over w - 1 as pos, count(*) over (partition by t.sample_id) as n_ev,
        lag(s) over w as prev, sum(volume) over (partition by t.sample_id) as vs from {src} t
        window w as (partition by t.sample_id order by s desc, {TIES}))"""
    zero = "0e0, " if action else ""
    select = f"""select sample_id, pos, n_ev, r6(ln(1+greatest(coalesce(prev-s, s),0e0))) as dt_log, r6({clipped("s/60e0", 0, 1)}) as t_pos,
        cast(side as double) as side, {act}r6({clipped("(price-mid0)/U_s", -64, 64)}) as px_dev, r6(asinh(volume/greatest(vs/60e0,1e0))) as vol_rel
        from ev join sc using (sample_id)
      union all select sample_id, 0, 0, 0e0, 0e0, 0e0, {zero}0e0, 0e0 from calendar where sample_id not in (select sample_id from {src})"""
    return ctes, select


C, SEL = event_sql("trade", False)


@check("q7_trade_events", views="market trade calendar", ctes=C, select=SEL)
def trade_events(e: Episodes):
    return round6_all(S.event_sequence(e.trade, e.calendar, S.snapshot_index(e.market)))


C, SEL = event_sql("ord", True)


@check("q7_order_events", views="market ord calendar", ctes=C, select=SEL)
def order_events(e: Episodes):
    return round6_all(S.event_sequence(e.order, e.calendar, S.snapshot_index(e.market)))


@check(
    "q8_order_contract",
    views="trade",
    ctes=f"""o as (select *, row_number() over (partition by sample_id order by s desc, {TIES}) as seq from trade),
      p as (select *, lag(s) over (partition by sample_id order by seq) as prev from o),
      r as (select *, lag(s) over (partition by sample_id order by {TIES}) as prev from trade)""",
    select="""select 'event order' as contract, (select count(*) from p where s>prev) as violations
      union all select 'key order', (select count(*) from r where s>prev)""",
)
def order_contract(e: Episodes):
    numbered = e.trade.map(lambda _: e.trade.ordered(newest=False, idx="seq", total=None))
    good = S.order_violations(numbered, "seq").agg(F.lit("event order").alias("contract"), F.count(F.lit(1)).alias("violations"))
    key = F.struct(*e.trade.ties)
    by_key = e.trade.map(lambda df: df.withColumn("k", key))
    bad = S.order_violations(by_key, "k").agg(F.lit("key order").alias("contract"), F.count(F.lit(1)).alias("violations"))
    return good.unionByName(bad)


@check(
    "q10_right_pad",
    views="trade months",
    ctes=f"""e as (select sample_id, volume, row_number() over (partition by sample_id order by s desc, {TIES}) - 1 as pos,
      count(*) over (partition by sample_id) as n from trade)""",
    select="""select sample_id, cast(max(n) as bigint) as length, (select cast(max(n) as bigint) from e) as padded,
      r6(sum(volume)) as vol, r6(arg_min(volume, pos)) as first_vol from e group by sample_id""",
)
def right_padded(e: Episodes):
    seq = e.trade.ordered(newest=False, idx="pos")
    vec = F.struct(F.col("pos"), F.array(F.col("volume")).alias("v"))
    arrays = seq.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(vec)), lambda r: r["v"]).alias("x"))
    p = S.right_pad(arrays, "x", None, 1)
    total = F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r[0])
    return round6_all(
        p.select("sample_id", F.col("length").cast("long"), F.size("x").cast("long").alias("padded"), total.alias("vol"), F.col("x")[0][0].alias("first_vol"))
    )


@check(
    "q11_event_counts",
    views="trade calendar",
    ctes="""c as (select m.sample_id, count(t.s) as c from calendar m left join trade t on t.sample_id=m.sample_id group by 1)""",
    select="""select r6(avg(c)) as mean, max(c) as max, r6(quantile_cont(c,0.5)) as q5, r6(quantile_cont(c,0.9)) as q9,
      r6(quantile_cont(c,0.99)) as q99, r6(quantile_cont(c,0.999)) as q999 from c""",
)
def event_counts(e: Episodes):
    return round6_all(S.event_count_profile(e.trade, e.calendar, hot=e.hot_all, limit=e.limit))


# ---- the 60 x 1 s grid --------------------------------------------------------------------------

BIN = "greatest(least(59-cast(floor(s) as int),59),0)"
CELLS = f"""go as (select sample_id, {BIN} as bin, fsum(volume, side=0 and order_action=0) as nb, fsum(volume, side=1 and order_action=0) as ns,
      fsum(volume, side=0 and order_action=1) as cb, fsum(volume, side=1 and order_action=1) as cs, stddev_samp(price) as opx_std,
      count(*) as ocnt, fcnt(side=0) as obcnt, sum(price*volume) as opxv, sum(volume) as ovol from ord group by 1,2),
    tm as (select *, avg(volume) over (partition by sample_id) as vm from trade),
    gt as (select sample_id, {BIN} as bin, fsum(volume, side=0) as tb, fsum(volume, side=1) as ts, sum(volume) as tvol, sum(price*volume) as tpxv,
      count(*) as tcnt, fcnt(side=0) as tbcnt, max(volume) as t_maxv, max(s) as tsec_max, min(s) as tsec_min,
      fsum(volume, side=0 and volume>2*vm) as big_buy, fsum(volume, side=1 and volume>2*vm) as big_sell from tm group by 1,2),
    slots as (select sample_id, unnest(range(0,60)) as bin from months),
    ce as (select slots.sample_id, cast(slots.bin as int) as bin,
      {", ".join(f"coalesce({c},0) as {c}" for c in ("nb", "ns", "cb", "cs", "opx_std", "ocnt", "obcnt", "opxv", "ovol", "tb", "ts", "tvol", "tpxv", "tcnt", "tbcnt", "t_maxv", "tsec_max", "tsec_min", "big_buy", "big_sell"))}
      from slots left join go on go.sample_id=slots.sample_id and go.bin=slots.bin left join gt on gt.sample_id=slots.sample_id and gt.bin=slots.bin)"""
RAW_CELLS = "nb ns cb cs opx_std opxv ovol tb ts tvol tpxv t_maxv tsec_max tsec_min big_buy big_sell".split()
COUNT_CELLS = "ocnt obcnt tcnt tbcnt".split()


@check(
    "q5_second_aggregates",
    views="ord trade months",
    ctes=CELLS,
    select="select sample_id, bin, " + ", ".join(f"r6({c}) as {c}" for c in RAW_CELLS) + ", " + ", ".join(COUNT_CELLS) + " from ce",
)
def second_aggregates(e: Episodes):
    return round6_all(grid.flow_cells(e.order, e.trade, e.months))


TOT = """tt as (select ce.*, U_s, greatest(sum(nb+ns) over p/60e0,1e0) as ou, greatest(sum(cb+cs) over p/60e0,1e0) as cu,
      greatest(sum(tvol) over p/60e0,1e0) as tu, coalesce(div(sum(opxv) over p, sum(ovol) over p),0) as ovw,
      coalesce(div(sum(tpxv) over p, sum(tvol) over p),0) as tvw, coalesce(div(sum(tvol) over p, sum(tcnt) over p),0) as tsz,
      max(case when ocnt+tcnt>0 then bin end) over (partition by sample_id order by bin) as lastpos
      from ce join sc using (sample_id) window p as (partition by sample_id))"""


def soft(num: str, den: str) -> str:
    return f"case when {den}>0 then ({num})/({den}+1e-6) else 0e0 end"


FLOW = {
    "o_new_buy": "asinh(nb/ou)",
    "o_new_sell": "asinh(ns/ou)",
    "o_cancel_buy": "asinh(cb/cu)",
    "o_cancel_sell": "asinh(cs/cu)",
    "o_new_imb": soft("nb-ns", "(nb+ns)"),
    "o_cancel_ratio": soft("cb+cs", "(nb+ns+cb+cs)"),
    "o_px_dev": f"case when ovol>0 then {clipped('(opxv/ovol-ovw)/U_s', -50, 50)} else 0e0 end",
    "t_vol_buy": "asinh(tb/tu)",
    "t_vol_sell": "asinh(ts/tu)",
    "t_imb": soft("tb-ts", "(tb+ts)"),
    "t_px_dev": f"case when tvol>0 then {clipped('(tpxv/tvol-tvw)/U_s', -50, 50)} else 0e0 end",
    "t_size_rel": f"case when tcnt>0 then {clipped('(tvol/tcnt)/(tsz+1e-6)-1', -5, 5)} else 0e0 end",
    "x_to_buy_diff": "case when tcnt>0 and ocnt>0 then cast(tbcnt as double)/tcnt - cast(obcnt as double)/ocnt else 0e0 end",
    "x_flow_gap": f"{clipped('cast(bin-coalesce(lastpos,-1) as double)', 0, 10)}/10e0",
    "flow_cnt": "asinh(cast(ocnt+tcnt as double))",
    "has_event": "case when ocnt+tcnt>0 then 1e0 else 0e0 end",
}


@check(
    "q3_flow_grid",
    views="market ord trade months",
    ctes=FILL + ", " + CELLS + ", " + TOT,
    select="select sample_id, bin, " + ", ".join(f"r6({x}) as {c}" for c, x in FLOW.items()) + " from tt",
)
def flow_grid(e: Episodes):
    return round6_all(grid.flow_channels(grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market)))


@check(
    "q3_flow_arrays",
    views="market ord trade months",
    ctes=FILL + ", " + CELLS + ", " + TOT,
    select="select sample_id, bin, " + ", ".join(f"r6({x}) as {c}" for c, x in FLOW.items()) + " from tt",
)
def flow_arrays(e: Episodes):
    return round6_all(slots.flow_channels(grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market)))


DERIVE = """d0 as (select ce.*, U_s, coalesce(div(tb-ts, tb+ts),0e0) as im, coalesce(div(tpxv, tvol),0e0) as vw,
      coalesce(div(sum(tvol) over p, sum(tcnt) over p),0e0) as vmean from ce join sc using (sample_id) window p as (partition by sample_id)),
    d1 as (select *, case when tvol>0 then coalesce(abs(vw-lag(vw) over w),0e0) else 0e0 end as dpx,
      sign(im)*1e0 as sg, coalesce(lag(sign(im)) over w <> sign(im), true) as chg, tcnt>0 and t_maxv>2*vmean as isbig,
      max(abs(im)) over (partition by sample_id) as am from d0 window w as (partition by sample_id order by bin)),
    d2 as (select *, max(case when chg then bin end) over w as started, max(case when isbig then bin end) over w as lastbig,
      max(ocnt+tcnt) over (partition by sample_id order by bin rows between 9 preceding and current row) as mx,
      min(case when abs(im)=am then bin end) over (partition by sample_id) as peakbin,
      count(*) over r as cn, sum(tvol) over r as sx, sum(dpx) over r as sy, sum(tvol*tvol) over r as sxx, sum(dpx*dpx) over r as syy, sum(tvol*dpx) over r as sxy
      from d1 window w as (partition by sample_id order by bin), r as (partition by sample_id order by bin rows between 19 preceding and current row)),
    d3 as (select d2.*, pk.im as peak, sqrt(greatest(cn*sxx-sx*sx,0e0)*greatest(cn*syy-sy*sy,0e0)) as den
      from d2 join d1 pk on pk.sample_id=d2.sample_id and pk.bin=d2.peakbin)"""


def part(num: str, den: str) -> str:
    return f"coalesce(div({num}, {den}),0e0)"


DERIVED = {
    "o_cancel_imb": part("cb-cs", "cb+cs"),
    "o_cancel_ratio_buy": part("cb", "cb+nb"),
    "o_cancel_ratio_sell": part("cs", "cs+ns"),
    "t_big_imb": part("big_buy-big_sell", "tvol"),
    "t_imb_run": "sg*least(bin-started+1,10)/10e0",
    "since_big_txn": "least(coalesce(bin-lastbig,30),30)/30e0",
    "txn_burst_10s": "asinh(cast(mx as double))",
    "t_imb_peak": "peak",
    "vol_px_corr": "case when cn>=20 and den>0 then (cn*sxy-sx*sy)/den else 0e0 end",
    "t_intragap": f"case when tcnt>=2 then {clipped('(tsec_max-tsec_min)/(tcnt-1)', 0, 1)} else 0e0 end",
    "o_px_disp": clipped("opx_std/U_s", 0, 50),
}


def derived_sql(*cols: str) -> str:
    return "select sample_id, bin, " + ", ".join(f"r6({DERIVED[c]}) as {c}" for c in cols) + " from d3"


ALL_DERIVED = FILL + ", " + CELLS + ", " + DERIVE


@check("q4_derived_channels", views="market ord trade months", ctes=ALL_DERIVED, select=derived_sql(*DERIVED))
def derived(e: Episodes):
    return round6_all(grid.derived_channels(grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market)))


@check("q4_derived_arrays", views="market ord trade months", ctes=ALL_DERIVED, select=derived_sql(*DERIVED))
def derived_arrays(e: Episodes):
    return round6_all(slots.derived_channels(grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market)))


def one_channel(name: str, *cols: str):
    @check(name, views="market ord trade months", ctes=ALL_DERIVED, select=derived_sql(*cols))
    def run(e: Episodes):
        return derived(e).select("sample_id", "bin", *cols)


one_channel("w9_since_event", "since_big_txn")
one_channel("w10_signed_run", "t_imb_run")
one_channel("w11_rolling", "txn_burst_10s", "vol_px_corr")
one_channel("w14_signed_peak", "t_imb_peak")


@check(
    "q6_reduced_grid",
    views="market ord trade months",
    ctes=FILL + ", " + CELLS + ", " + TOT + ", ch as (select sample_id, bin, " + ", ".join(f"{x} as {c}" for c, x in FLOW.items()) + " from tt)",
    select="select sample_id, " + ", ".join(f"r6(avg({c})) as {c}_full, r6(favg({c}, bin>=58)) as {c}_last2" for c in FLOW) + " from ch group by sample_id",
)
def reduced(e: Episodes):
    ch = grid.flow_channels(grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market))
    return round6_all(grid.reduce_grid(ch))


@check(
    "q12_joined_channels",
    views="market ord trade months",
    ctes=ALL_DERIVED + ", " + TOT,
    select=f"""select tt.sample_id, tt.bin, r6({FLOW["t_imb"].replace("tb", "tt.tb").replace("ts)", "tt.ts)").replace("-ts", "-tt.ts")}) as t_imb,
      r6(d3.peak) as t_imb_peak from tt join d3 on d3.sample_id=tt.sample_id and d3.bin=tt.bin""",
)
def joined_channels(e: Episodes):
    cells, scale = grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market)
    both = grid.join_channels(grid.flow_channels(cells, scale), grid.derived_channels(cells, scale))
    return round6_all(both.select("sample_id", "bin", "t_imb", "t_imb_peak"))
