"""The 60 x 1 s grid of an episode: bin 59 holds the last second before prediction time, bin 0 the
oldest. After the first aggregation an episode has at most 60 rows, so the windows below are
bounded whatever the size of the episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import fsum
from ..functions.scalars import clip, div, ratio0
from .ordered import Tape, dealt, with_group_values

BINS = 60
EPS = 1e-6
BIG_MULTIPLE = 2.0
RUN_CAP, SINCE_CAP, BURST_BINS, CORR_BINS = 10, 30, 10, 20

# fixed values: channel names in their published order
FLOW_CHANNELS = """
o_new_buy o_new_sell o_cancel_buy o_cancel_sell o_new_imb o_cancel_ratio o_px_dev
t_vol_buy t_vol_sell t_imb t_px_dev t_size_rel x_to_buy_diff x_flow_gap flow_cnt has_event
""".split()
DERIVED_CHANNELS = """
o_cancel_imb o_cancel_ratio_buy o_cancel_ratio_sell t_big_imb t_imb_run since_big_txn
txn_burst_10s t_imb_peak vol_px_corr t_intragap o_px_disp
""".split()


def bin_of_clock(clock: str | Column = "s", bins: int = BINS) -> Column:
    c = F.col(clock) if isinstance(clock, str) else clock
    return F.greatest(F.least(F.lit(bins - 1) - F.floor(c).cast("int"), F.lit(bins - 1)), F.lit(0))


def flow_cells(orders: Tape, trades: Tape, ids: DataFrame) -> DataFrame:
    """Raw aggregates per (episode, bin) for every episode of `ids` and all 60 bins, 0 where nothing
    happened. Empty bins travel as zero rows of the same union. Episodes below the row limit are dealt in tasks of a bounded
    number of events; else orders, trades and grid meet in one shuffle that is combined map-side."""
    k = trades.key
    t = with_group_values(trades, {"_vmean": F.avg("volume")})
    shape = [k, "bin", "src", "s", "price", "volume", "side", "action", "big"]
    none = F.lit(None)
    o = orders.df.select(
        k, bin_of_clock(orders.clock).alias("bin"), F.lit("o").alias("src"), F.col(orders.clock).alias("s"),
        "price", "volume", "side", F.col("order_action").alias("action"), F.lit(False).alias("big"),
    )
    t = t.select(
        k, bin_of_clock(trades.clock).alias("bin"), F.lit("t").alias("src"), F.col(trades.clock).alias("s"),
        "price", "volume", "side", none.cast("int").alias("action"),
        (F.col("volume") > BIG_MULTIPLE * F.col("_vmean")).alias("big"),
    )
    grid = ids.select(
        k, F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), none.cast("string").alias("src"),
        none.cast("double").alias("s"), none.cast("double").alias("price"), none.cast("double").alias("volume"),
        none.cast("int").alias("side"), none.cast("int").alias("action"), F.lit(False).alias("big"),
    )
    o, t = o.select(shape), t.select(shape)
    if trades.rows is not None and trades.hot is None and orders.hot is None:
        # the raw events are narrower than their cells: dealt by episode once, their aggregates and windows need no further exchange
        o, t, grid = dealt(o, k, trades.rows), dealt(t, k, trades.rows), dealt(grid, k, trades.rows)
    rows = o.unionByName(t).unionByName(grid)
    is_o, is_t, buy, sell = F.col("src") == "o", F.col("src") == "t", F.col("side") == 0, F.col("side") == 1
    new, gone = F.col("action") == 0, F.col("action") == 1
    pv, zero = F.col("price") * F.col("volume"), F.lit(0.0)
    return rows.groupBy(k, "bin").agg(
        fsum("volume", is_o & new & buy).alias("nb"),
        fsum("volume", is_o & new & sell).alias("ns"),
        fsum("volume", is_o & gone & buy).alias("cb"),
        fsum("volume", is_o & gone & sell).alias("cs"),
        F.coalesce(F.stddev_samp(F.when(is_o, F.col("price"))), zero).alias("opx_std"),
        F.count_if(is_o).alias("ocnt"),
        F.count_if(is_o & buy).alias("obcnt"),
        fsum(pv, is_o).alias("opxv"),
        fsum("volume", is_o).alias("ovol"),
        fsum("volume", is_t & buy).alias("tb"),
        fsum("volume", is_t & ~buy).alias("ts"),
        fsum("volume", is_t).alias("tvol"),
        fsum(pv, is_t).alias("tpxv"),
        F.count_if(is_t).alias("tcnt"),
        F.count_if(is_t & buy).alias("tbcnt"),
        F.coalesce(F.max(F.when(is_t, F.col("volume"))), zero).alias("t_maxv"),
        F.coalesce(F.max(F.when(is_t, F.col("s"))), zero).alias("tsec_max"),
        F.coalesce(F.min(F.when(is_t, F.col("s"))), zero).alias("tsec_min"),
        fsum("volume", is_t & F.col("big") & buy).alias("big_buy"),
        fsum("volume", is_t & F.col("big") & ~buy).alias("big_sell"),
    )


# ---- window operators along the bins ------------------------------------------------------------


def _upto(key: str):
    return Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def _whole(key: str):
    return Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _last(key: str, bins: int):
    return Window.partitionBy(key).orderBy("bin").rowsBetween(-(bins - 1), 0)


def last_position(cond: Column, key: str) -> Column:
    """Bin of the latest row up to this one where cond holds, null before the first."""
    return F.max(F.when(cond, F.col("bin"))).over(_upto(key))


def since(cond: Column, key: str, cap: int) -> Column:
    """Bins since cond last held, capped and scaled to [0, 1]; 1 if it never did."""
    gap = F.col("bin") - last_position(cond, key)
    return F.least(F.coalesce(gap, F.lit(cap)), F.lit(cap)) / F.lit(float(cap))


def with_signed_run(df: DataFrame, x: Column, key: str, out: str, cap: int = RUN_CAP) -> DataFrame:
    """Adds the signed run length: how many bins in a row had this sign, capped and scaled to [-1, 1]."""
    w = Window.partitionBy(key).orderBy("bin")
    df = df.withColumn("_sgn", F.signum(x))
    df = df.withColumn("_chg", F.coalesce(F.lag("_sgn").over(w) != F.col("_sgn"), F.lit(True)))
    run = F.col("bin") - last_position(F.col("_chg"), key) + 1
    return df.withColumn(out, F.col("_sgn") * F.least(run, F.lit(cap)) / F.lit(float(cap))).drop("_sgn", "_chg")


def with_peak(df: DataFrame, x: Column, key: str, out: str) -> DataFrame:
    """Signed value at the largest |x| of the episode (the oldest on ties), on every bin."""
    df = df.withColumn("_x", x)
    df = df.withColumn("_m", F.max(F.abs("_x")).over(_whole(key)))
    return df.withColumn(out, F.first(F.when(F.abs("_x") == F.col("_m"), F.col("_x")), True).over(_whole(key))).drop("_x", "_m")


def rolling_corr(x: Column, y: Column, key: str, bins: int) -> Column:
    """Pearson correlation over the last `bins` rows; 0 until the window is full and on constant input."""
    w = _last(key, bins)
    n = F.count(F.lit(1)).over(w)
    sx, sy = F.sum(x).over(w), F.sum(y).over(w)
    vx = F.greatest(n * F.sum(x * x).over(w) - sx * sx, F.lit(0.0))
    vy = F.greatest(n * F.sum(y * y).over(w) - sy * sy, F.lit(0.0))
    return F.when(n >= bins, ratio0(n * F.sum(x * y).over(w) - sx * sy, F.sqrt(vx * vy))).otherwise(F.lit(0.0))


# ---- channels -----------------------------------------------------------------------------------


def flow_channels(cells: DataFrame, scale: DataFrame, *, key: str = "sample_id", eps: float = EPS) -> DataFrame:
    """The 16 flow channels per (episode, bin). `scale` has U_s per episode, already without nulls."""
    w = Window.partitionBy(key)
    df = cells.join(scale.select(key, "U_s"), key)
    tot = lambda c: F.sum(c).over(w)
    df = df.select(
        "*",
        F.greatest(tot(F.col("nb") + F.col("ns")) / BINS, F.lit(1.0)).alias("_ou"),
        F.greatest(tot(F.col("cb") + F.col("cs")) / BINS, F.lit(1.0)).alias("_cu"),
        F.greatest(tot("tvol") / BINS, F.lit(1.0)).alias("_tu"),
        ratio0(tot("opxv"), tot("ovol")).alias("_ovw"),
        ratio0(tot("tpxv"), tot("tvol")).alias("_tvw"),
        ratio0(tot("tvol"), tot("tcnt")).alias("_tsz"),
        (F.col("ocnt") + F.col("tcnt") > 0).alias("_has"),
    )

    def dev(pv: str, vol: str, base: str) -> Column:
        return F.when(F.col(vol) > 0, clip(div(div(pv, vol) - F.col(base), "U_s"), -50, 50)).otherwise(F.lit(0.0))

    def soft(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / (den + F.lit(eps))).otherwise(F.lit(0.0))

    nb, ns, cb, cs, tb, ts = (F.col(c) for c in ("nb", "ns", "cb", "cs", "tb", "ts"))
    both = (F.col("tcnt") > 0) & (F.col("ocnt") > 0)
    gap = F.col("bin") - F.coalesce(last_position(F.col("_has"), key), F.lit(-1))
    out = {
        "o_new_buy": F.asinh(nb / F.col("_ou")),
        "o_new_sell": F.asinh(ns / F.col("_ou")),
        "o_cancel_buy": F.asinh(cb / F.col("_cu")),
        "o_cancel_sell": F.asinh(cs / F.col("_cu")),
        "o_new_imb": soft(nb - ns, nb + ns),
        "o_cancel_ratio": soft(cb + cs, nb + ns + cb + cs),
        "o_px_dev": dev("opxv", "ovol", "_ovw"),
        "t_vol_buy": F.asinh(tb / F.col("_tu")),
        "t_vol_sell": F.asinh(ts / F.col("_tu")),
        "t_imb": soft(tb - ts, tb + ts),
        "t_px_dev": dev("tpxv", "tvol", "_tvw"),
        "t_size_rel": F.when(
            F.col("tcnt") > 0, clip(div("tvol", "tcnt") / (F.col("_tsz") + F.lit(EPS)) - 1, -5, 5)
        ).otherwise(F.lit(0.0)),
        "x_to_buy_diff": F.when(both, div("tbcnt", "tcnt") - div("obcnt", "ocnt")).otherwise(F.lit(0.0)),
        "x_flow_gap": clip(gap.cast("double"), 0, 10) / 10,
        "flow_cnt": F.asinh((F.col("ocnt") + F.col("tcnt")).cast("double")),
        "has_event": F.col("_has").cast("double"),
    }
    return df.select(key, "bin", *[out[c].alias(c) for c in FLOW_CHANNELS])


def derived_channels(cells: DataFrame, scale: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """The 11 derived channels per (episode, bin)."""
    w = Window.partitionBy(key)
    tvol, tcnt = F.col("tvol"), F.col("tcnt")
    df = cells.join(scale.select(key, "U_s"), key).withColumn("_imb", ratio0(F.col("tb") - F.col("ts"), F.col("tb") + F.col("ts")))
    df = df.withColumn("_vw", ratio0("tpxv", "tvol"))
    step = F.abs(F.col("_vw") - F.lag("_vw").over(Window.partitionBy(key).orderBy("bin")))
    df = df.withColumn("_dpx", F.when(tvol > 0, F.coalesce(step, F.lit(0.0))).otherwise(F.lit(0.0)))
    df = df.withColumn("_vmean", ratio0(F.sum("tvol").over(w), F.sum("tcnt").over(w)))
    df = df.withColumn("_big", (tcnt > 0) & (F.col("t_maxv") > BIG_MULTIPLE * F.col("_vmean")))
    df = with_signed_run(df, F.col("_imb"), key, "t_imb_run")
    df = with_peak(df, F.col("_imb"), key, "t_imb_peak")
    cb, cs, nb, ns = (F.col(c) for c in ("cb", "cs", "nb", "ns"))
    out = {
        "o_cancel_imb": ratio0(cb - cs, cb + cs),
        "o_cancel_ratio_buy": ratio0(cb, cb + nb),
        "o_cancel_ratio_sell": ratio0(cs, cs + ns),
        "t_big_imb": ratio0(F.col("big_buy") - F.col("big_sell"), tvol),
        "t_imb_run": F.col("t_imb_run"),
        "since_big_txn": since(F.col("_big"), key, SINCE_CAP),
        "txn_burst_10s": F.asinh(F.max((F.col("ocnt") + tcnt).cast("double")).over(_last(key, BURST_BINS))),
        "t_imb_peak": F.col("t_imb_peak"),
        "vol_px_corr": rolling_corr(tvol, F.col("_dpx"), key, CORR_BINS),
        "t_intragap": F.when(
            tcnt >= 2, clip(div(F.col("tsec_max") - F.col("tsec_min"), tcnt - 1), 0, 1)
        ).otherwise(F.lit(0.0)),
        "o_px_disp": clip(div("opx_std", "U_s"), 0, 50),
    }
    return df.select(key, "bin", *[out[c].alias(c) for c in DERIVED_CHANNELS])


def join_channels(a: DataFrame, b: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """Base and derived channels of the same cell side by side."""
    return a.join(b, [key, "bin"])


def reduce_grid(channels: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """Per episode the mean of each channel over all bins and over the last two."""
    names = [c for c in channels.columns if c not in (key, "bin")]
    last2 = F.col("bin") >= BINS - 2
    return channels.groupBy(key).agg(
        *[F.avg(c).alias(f"{c}_full") for c in names],
        *[F.avg(F.when(last2, F.col(c))).alias(f"{c}_last2") for c in names],
    )
