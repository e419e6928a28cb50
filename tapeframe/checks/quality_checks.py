"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import cosine
from ..functions.scalars import round6_all
from ..operators import grid, quality as Q, screening, sequences as S, slots
from ..operators.ordered import find_hot
from ..plans import names
from ..sources.adapters import Episodes
from .registry import check
from .sequence_checks import CELLS, DERIVE, DERIVED, FILL, FLOW, SNAP, TOT
from .screening_checks import ALL_FACTORS, AV, all_factors
from .sql import TIES

PROFILE = """p as (select sample_id, min(s) as clock_min, max(s) as clock_max, cast(count(*) as double) as row_count from {src} group by 1)"""


def profile_sql(src: str) -> dict:
    one = "select cast(sum(row_count) as bigint) as rows, count(*) as episodes, r6(sum(row_count)/count(*)) as rows_per_episode, '{c}' as stat, r6(min({c})) as min, r6(max({c})) as max, r6(avg({c})) as mean, r6(quantile_cont({c},0.5)) as median from p"
    return dict(views=src, ctes=PROFILE.format(src=src), select=" union all ".join(one.format(c=c) for c in ("clock_min", "clock_max", "row_count")))


@check("dq1_profile_market", **profile_sql("market"))
def profile_market(e: Episodes):
    return round6_all(Q.table_profile(e.market, hot=e.hot_all))


@check("dq1_profile_trades", **profile_sql("trade"))
def profile_trades(e: Episodes):
    return round6_all(Q.table_profile(e.trade, hot=e.hot_all))


COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
KINDS = {c: "bigint" for c in COLS[:3]} | {"l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@check(
    "io9_column_profile",
    select=" union all ".join(
        f"select '{c}' as \"column\", '{KINDS.get(c, 'double')}' as type, count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\" from lineitem" for c in COLS
    ),
)
def column_profile(e: Episodes):
    return Q.column_profile(e.table("lineitem"), COLS)


@check(
    "dq2_target_profile",
    views="label",
    ctes="q as (select sample_id, month, r6(target) as target from label)",
    select="select count(*) as episodes, r6(avg(case when target=0 then 1e0 else 0e0 end)) as zero_share, count(distinct target) as \"distinct\" from q",
)
def target_profile(e: Episodes):
    return round6_all(Q.target_profile(round6_all(e.label)))


@check("dq2_top_values", views="ord", select="select volume, count(*) as count from ord group by 1 order by count desc, volume limit 8")
def top_values(e: Episodes):
    return Q.top_values(e.order.df, "volume", 8)


PERIOD = "select month, r6(avg(target)) as mean, r6(stddev_samp(target)) as std, count(target) as count, r6(min(target)) as min, r6(max(target)) as max, min(sample_id) as first_id, max(sample_id) as last_id from label group by month"


@check("dq2_period_stats", views="label", select=PERIOD)
def period_stats(e: Episodes):
    return round6_all(Q.period_stats(e.label))


@check("a13_period_summary", views="label", select=PERIOD)
def period_summary(e: Episodes):
    return round6_all(Q.period_stats(e.label))


def gap_sql(src: str, old: str) -> tuple[str, str]:
    edges = Q.GAP_EDGES
    ctes = f"""g as (select lag(s) over (partition by sample_id order by {old}) - s as gap from {src}), h as (select * from g where gap is not null)"""
    shares = ", ".join(f"r6(avg(case when gap>={lo} and gap<{hi} then 1e0 else 0e0 end)) as share_{i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    qs = ", ".join(f"r6(quantile_cont(gap,{q})) as q{str(q)[2:]}" for q in (0.5, 0.9, 0.99, 0.999))
    return ctes, f"select count(*) as gaps, r6(avg(gap)) as mean, r6(max(gap)) as max, fcnt(gap<-1e-6) as inversions, fcnt(abs(gap)<1e-9) as duplicates, {shares}, {qs} from h"


C, SEL = gap_sql("market", "s desc")


@check("dq3_gap_report", views="market", ctes=C, select=SEL)
def gap_report(e: Episodes):
    return round6_all(Q.gap_report(e.market, hot=e.hot_all_trades))


C, SEL = gap_sql("trade", TIES)


@check("dq3_inversions", views="trade", ctes=C, select=SEL)
def inversions(e: Episodes):
    keyed = e.trade.map(lambda df: df.withColumn("k", F.struct(*e.trade.ties)))
    return round6_all(Q.gap_report(keyed, hot=e.hot_all_trades, file_order="k"))


CLICKS = """ck as (select user_id as sample_id, -epoch_us(ts)/1e6 as s, event_id from events),"""


@check(
    "dq3_wall_clock_gaps",
    ctes=CLICKS + " c2 as (select *, lag(s) over (partition by sample_id order by s desc, event_id) - s as gap from ck)",
    select="select sample_id, count(*) as rows, r6(coalesce(max(gap),0)) as gap_max, r6(coalesce(sum(gap),0)) as gap_sum, fcnt(gap>3600) as long_gaps from c2 group by 1",
)
def wall_clock(e: Episodes):
    g = Q.gaps(e.clicks)
    return round6_all(
        g.groupBy("sample_id").agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap_max"),
            F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_sum"), F.count_if(F.col("gap") > 3600).alias("long_gaps"),
        )
    )


COVER = """g as (select *, lag(s) over w as prev, coalesce(lag(s) over w - s, 0e0) as gap from market window w as (partition by sample_id order by s desc)),
    cv as (select sample_id, count(*) as rows, max(gap) as gap_max, sum(gap) as gap_sum, sum(greatest(gap-3e0,0e0)) as excess_sum, max(s) as first_s,
      min(s) as last_s, max(s)-min(s) as span, fcnt(s<=60) as tail_rows, max(case when prev<=60 then gap else 0e0 end) as tail_gap_max from g group by 1)"""


@check(
    "dq4_coverage",
    views="market",
    ctes=COVER,
    select="select sample_id, rows, tail_rows, " + ", ".join(f"r6({c}) as {c}" for c in ("gap_max", "gap_sum", "excess_sum", "first_s", "last_s", "span", "tail_gap_max")) + " from cv",
)
def coverage(e: Episodes):
    return round6_all(Q.coverage(e.market))


@check(
    "dq5_coverage_drift",
    views="market months",
    ctes=COVER,
    select="""select month, count(*) as episodes, r6(avg(rows)) as mean_rows, r6(avg(gap_max)) as mean_max_gap,
      r6(avg(case when gap_max>10 then 1e0 else 0e0 end)) as wide_gap_share, r6(avg(last_s)) as mean_last_s from cv join months using (sample_id) group by month""",
)
def drift(e: Episodes):
    return round6_all(Q.coverage_drift(Q.coverage(e.market), e.months))


CHANNELS = FILL + ", " + CELLS + ", " + TOT + ", ch as (select sample_id, bin, " + ", ".join(f"{x} as {c}" for c, x in FLOW.items()) + " from tt)"


def flow(e: Episodes, eps: float = grid.EPS):
    return grid.flow_channels(grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market), eps=eps)


@check(
    "dq6_channel_health",
    views="market ord trade months",
    ctes=CHANNELS,
    select=" union all ".join(
        f"""select '{c}' as channel, count(*) as rows, true as finite, r6(avg(case when {c}<>0 then 1e0 else 0e0 end)) as nonzero_share, r6(stddev_pop({c})) as std,
        case when stddev_pop({c})=0 then 'constant' when avg(case when {c}<>0 then 1e0 else 0e0 end)<0.01 then 'almost all zero' else 'ok' end as state from ch"""
        for c in FLOW
    ),
)
def health(e: Episodes):
    return round6_all(Q.channel_health(flow(e), grid.FLOW_CHANNELS))


# fixed values: documented cosine of the reference signals
REFERENCE = [("t_imb_last2", 0.0733), ("t_imb_full", 0.0541), ("x_to_buy_diff_full", 0.0214)]


@check(
    "dq7_known_positive_gate",
    views="market ord trade months label",
    ctes=CHANNELS + """, rd as (select sample_id, favg(t_imb, bin>=58) as t_imb_last2, avg(t_imb) as t_imb_full, avg(x_to_buy_diff) as x_to_buy_diff_full from ch group by 1),
      sc2 as (""" + " union all ".join(f"select '{s}' as signal, cosine({s}, target) as cos, {x}e0 as expected from rd join label using (sample_id)" for s, x in REFERENCE) + "), "
    + "ps as (select *, coalesce(abs(cos)>=0.6e0*expected, false) as passed from sc2)",
    select="select signal, expected, r6(cos) as cos, passed, (select bool_and(passed) from ps) as valid from ps",
)
def gate(e: Episodes):
    reduced = grid.reduce_grid(flow(e)).join(e.label, "sample_id")
    wide = reduced.agg(*[cosine(s, "target").alias(s) for s, _ in REFERENCE])
    tall = wide.unpivot([], [s for s, _ in REFERENCE], "signal", "cos")
    expected = e.spark.createDataFrame(REFERENCE, "signal string, expected double")
    return round6_all(Q.known_positive_gate(tall, expected), "expected")


SPLIT = "case when month < 6 then 'train' else 'test' end"
SHOWN = list(SNAP)


@check(
    "dq8_channel_medians",
    views="market months",
    ctes=FILL + ", m as (select " + SPLIT + " as split, " + ", ".join(f"{SNAP[c]} as {c}" for c in SHOWN) + " from b2 join sc using (sample_id) join months using (sample_id)),"
    " md as (" + " union all ".join(f"select '{c}' as channel, quantile_cont({c},0.5) filter (where split='train') as train, quantile_cont({c},0.5) filter (where split='test') as test from m" for c in SHOWN) + ")",
    select="select channel, r6(train) as train, r6(test) as test, r6(case when abs(train)>1e-9 then div(test,train) end) as ratio from md",
)
def medians(e: Episodes):
    seq = S.snapshot_sequence(e.market).join(e.months.select("sample_id", F.expr(SPLIT).alias("split")), "sample_id")
    hot = find_hot(e.base.select(F.expr("case when l_suppkey % 12 < 6 then 'train' else 'test' end").alias("split")), ["split"], e.limit)
    return round6_all(Q.channel_medians(seq, SHOWN, "split", hot=hot, limit=e.limit))


@check(
    "dq8_index_consistency",
    views="market calendar",
    ctes="i as (select sample_id, count(*) as n from market group by 1)",
    select="""select cast(0 as bigint) as unknown, (select count(*) from calendar where sample_id not in (select sample_id from i)) as missing, cast(0 as bigint) as duplicated""",
)
def index_rows(e: Episodes):
    return Q.index_consistency(S.snapshot_index(e.market), e.calendar)


@check(
    "dq9_null_shares",
    views=AV,
    ctes=ALL_FACTORS + ", y as (select " + ", ".join(f"avg(case when {c} is null then 1e0 else 0e0 end) as {c}" for c in names.ALL) + " from fx), z as (unpivot y on " + ", ".join(names.ALL) + " into name \"column\" value null_share)",
    select="select \"column\", r6(null_share) as null_share from z where null_share > 0.005",
)
def null_report(e: Episodes):
    return round6_all(Q.null_shares(all_factors(e), names.ALL, 0.005))


SOFT = ("o_new_imb", "o_cancel_ratio", "t_imb")


@check(
    "dq10_two_grids_agree",
    views="market ord trade months",
    ctes=CHANNELS + ", c0 as (select sample_id, bin, " + ", ".join(f"{x.replace('+1e-6)', ')') if c in SOFT else x} as {c}" for c, x in FLOW.items()) + " from tt), "
    + "j as (select " + ", ".join(f"ch.{c} as a_{c}, c0.{c} as b_{c}" for c in FLOW) + ", ch.bin is null or c0.bin is null as alone from ch full join c0 on ch.sample_id=c0.sample_id and ch.bin=c0.bin)",
    select=" union all ".join(f"select '{c}' as \"column\", r6(max(abs(a_{c}-b_{c})/greatest(abs(a_{c}),1e0))) as worst, fcnt(alone) as unmatched from j" for c in FLOW),
)
def grids_agree(e: Episodes):
    """The grid by windows against the grid by arrays, the latter without the small term of its soft ratios."""
    arrays = slots.flow_channels(grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market), eps=0.0)
    return round6_all(Q.relative_difference(flow(e), arrays, ["sample_id", "bin"], grid.FLOW_CHANNELS))


SCREENED = [*grid.FLOW_CHANNELS, *grid.DERIVED_CHANNELS]


@check(
    "e5_screen_channels",
    views="market ord trade months label",
    ctes=CHANNELS + ", " + DERIVE + ", dv as (select sample_id, bin, " + ", ".join(f"{x} as {c}" for c, x in DERIVED.items()) + " from d3), "
    + "red as (select ch.sample_id, " + ", ".join(f"avg({c}) as {c}_full, favg({c}, ch.bin>=58) as {c}_last2" for c in SCREENED)
    + " from ch join dv on ch.sample_id=dv.sample_id and ch.bin=dv.bin group by 1), "
    + "lg as (select month, target, unnest([" + ", ".join(f"{{'factor': '{c}', 'x': {c}_full, 'y': {c}_last2}}" for c in SCREENED) + "]) as u from red join label using (sample_id)), "
    + "by_period as (select u.factor as factor, month, cosine(u.x, target) as cos from lg group by 1, 2), "
    + "signs as (select factor, avg(case when cos>0 then 1e0 else 0e0 end) as pos_frac from by_period where cos is not null group by 1), "
    + "overall as (select u.factor as factor, cosine(u.x, target) as cos_full, cosine(u.y, target) as cos_last, fcnt(abs(u.x)>=1e-9)/cast(count(*) as double) as nonzero, min(u.x)=max(u.x) as same from lg group by 1)",
    select="""select factor, r6(nonzero) as nonzero, r6(cos_last) as cos_last, r6(cos_full) as cos_full, r6(pos_frac) as pos_frac,
      case when same or nonzero<0.01 then 'dead' when greatest(abs(cos_last),abs(cos_full))<0.02 and (pos_frac is null or pos_frac<0.55) then 'drop'
        when greatest(abs(cos_last),abs(cos_full))<0.05 then 'weak' else 'keep' end as verdict from overall left join signs using (factor)""",
)
def screen_channels(e: Episodes):
    cells, scale = grid.flow_cells(e.order, e.trade, e.months), S.snapshot_index(e.market)
    both = grid.join_channels(slots.flow_channels(cells, scale), slots.derived_channels(cells, scale))
    labelled = grid.reduce_grid(both).join(e.label.select("sample_id", "month", "target"), "sample_id")
    return round6_all(screening.screen_channels(labelled, SCREENED, dead=0.02))


@check(
    "so3_difference",
    views="trade ord",
    ctes="a as (select sample_id, s, price, volume, side from trade), b as (select sample_id, s, price, volume, side from ord)",
    select="select (select count(*) from (select * from a except all select * from b)) as only_a, (select count(*) from (select * from b except all select * from a)) as only_b",
)
def difference(e: Episodes):
    cols = ["sample_id", "s", "price", "volume", "side"]
    return Q.same_rows(e.trade.df.select(*cols), e.order.df.select(*cols))


@check(
    "dq11_edge_row_counts",
    views="market months",
    ctes="""c as (select sample_id, month, count(*) as rows from market join months using (sample_id) group by 1,2),
      r as (select *, row_number() over (partition by month order by sample_id) as i, row_number() over (partition by month order by sample_id desc) as j from c),
      u as (select month, 'first' as side, rows from r where i<=30 union all select month, 'last', rows from r where j<=30)""",
    select="select month, side, min(rows) as min, r6(quantile_cont(rows,0.5)) as median, max(rows) as max from u group by 1,2",
)
def edges(e: Episodes):
    return round6_all(Q.edge_row_counts(e.market, e.months, hot=e.hot_months))


IDX = ["pad_frac", "n_valid", "U_s", "o_n", "t_n"]


@check(
    "dq12_split_quantiles",
    views="market ord trade months",
    ctes=FILL + f""", x as (select {SPLIT} as split, 1-n_valid/224e0 as pad_frac, n_valid, U_s, o.c as o_n, t.c as t_n from sc join months using (sample_id)
      left join (select sample_id, count(*) as c from ord group by 1) o using (sample_id) left join (select sample_id, count(*) as c from trade group by 1) t using (sample_id))""",
    select=" union all ".join(
        f"select split, '{c}' as \"column\", r6(avg({c})) as mean, " + ", ".join(f"r6(quantile_cont({c},{q})) as q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from x group by split"
        for c in IDX
    ),
)
def split_quantiles(e: Episodes):
    count = lambda tape, name: tape.df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))
    df = S.snapshot_index(e.market).join(count(e.order, "o_n"), "sample_id", "left").join(count(e.trade, "t_n"), "sample_id", "left")
    df = df.withColumn("pad_frac", 1 - F.col("n_valid") / F.lit(224.0)).join(e.months.select("sample_id", F.expr(SPLIT).alias("split")), "sample_id")
    hot = find_hot(e.months.select(F.expr(SPLIT).alias("split")), ["split"], e.limit)
    return round6_all(Q.quantile_table(df, IDX, "split", hot=hot, limit=e.limit))
