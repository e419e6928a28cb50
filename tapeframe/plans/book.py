"""Per-episode order-book factors from snapshots, newest-first: idx 0 is the book at prediction time,
idx 19 and 39 are the 20th and 40th snapshot back."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import SPARK, Basic
from ..functions.scalars import div, imbalance
from ..operators.ordered import Tape
from ..operators.quantiles import quantiles

QUANTILES = {
    "m_imb_med": ("imb", 0.5, "linear"),
    "m_imb_q25": ("imb", 0.25, "nearest"),
    "m_sp_q75": ("spread_v", 0.75, "nearest"),
}


def quantities() -> list[Column]:
    """Row-level book quantities; *_v columns are null where one side is not quoted."""
    a1, b1, av1, bv1 = (F.col(c) for c in ("ask_price_1", "bid_price_1", "ask_volume_1", "bid_volume_1"))
    valid = (a1 > 0) & (b1 > 0)
    mid = (a1 + b1) / 2
    return [
        valid.alias("valid"),
        mid.alias("mid"),
        div(a1 * bv1 + b1 * av1, av1 + bv1).alias("micro"),
        (a1 - b1).alias("spread"),
        F.when(valid, mid).alias("mid_v"),
        F.when(valid, a1 - b1).alias("spread_v"),
        F.when(av1 + bv1 > 0, imbalance(bv1, av1)).alias("imb"),
        (av1 - bv1).alias("tilt"),
    ]


def with_book(df: DataFrame) -> DataFrame:
    return df.select("*", *quantities())


LAGS = {"_m1": ("mid", 1), "_mv1": ("mid_v", 1), "_t1": ("tilt", 1)}


def changes() -> dict[str, Column]:
    """Differences to the next newer snapshot, from the LAGS."""
    return {
        "dmid": F.col("mid") - F.col("_m1"),
        "dmid_v": F.coalesce(F.col("mid_v") - F.col("_mv1"), F.lit(0.0)),
        "dofi": F.coalesce(F.col("tilt") - F.col("_t1"), F.lit(0.0)),
    }


def rows(tape: Tape) -> DataFrame:
    return tape.map(with_book).ordered(lags=LAGS).select("*", *[c.alias(o) for o, c in changes().items()])


def value_at(i: int, x: str | Column, position: str = "idx", A: Basic = SPARK) -> Column:
    return A.max(F.when(F.col(position) == i, F.col(x) if isinstance(x, str) else x))


def oldest_value(x: str, within: Column | None = None, position: str = "idx", A: Basic = SPARK) -> Column:
    """Value of the oldest row (of those `within`), null kept."""
    i = F.col(position)
    return A.max_by(x, i if within is None else F.when(within, i))


def aggregates(clock: str = "s", position: str = "idx", A: Basic = SPARK) -> dict[str, Callable[[], Column]]:
    """name -> factor over an episode's snapshots; rows without clock and position are not snapshots."""
    fsum, favg, fstd, decayed_mean = A.fsum, A.favg, A.fstd, A.decayed_mean
    s, idx = F.col(clock), F.col(position)
    at, oldest = partial(value_at, position=position, A=A), partial(oldest_value, position=position, A=A)
    a1, b1, a2, b2 = (F.col(c) for c in ("ask_price_1", "bid_price_1", "ask_price_2", "bid_price_2"))
    av1, bv1, av2, bv2 = (F.col(c) for c in ("ask_volume_1", "bid_volume_1", "ask_volume_2", "bid_volume_2"))
    valid, dmid, dofi = F.col("valid"), F.col("dmid"), F.col("dofi")
    last20, s60 = idx < 20, s <= 60
    tilt = imbalance(bv1, av1)
    depth = av1 + bv1
    spread60 = favg("spread", last20)
    vol60, vol600 = fstd("dmid", last20), A.stddev_samp("dmid")
    up, down = fstd("dmid", last20 & (dmid > 0)), fstd("dmid", last20 & (dmid < 0))
    lo, hi = A.min("mid"), A.max("mid")
    level2 = (a2 > 0) & (b2 > 0) & (F.col("mid") > 0)
    all_depth = depth + av2 + bv2
    ask_slope = F.when(av2 != av1, div(a2 - a1, av2 - av1))
    bid_slope = F.when(bv1 != bv2, div(b1 - b2, bv1 - bv2))
    ask_slope60, bid_slope60 = favg(ask_slope, valid & s60), favg(bid_slope, valid & s60)
    rv60 = F.sqrt(fsum(F.pow("dmid_v", F.lit(2.0)), s60))
    rv600 = F.sqrt(fsum(F.pow("dmid_v", F.lit(2.0))))
    imb15, imb180 = favg("imb", s <= 15), favg("imb", s <= 180)
    txv = F.coalesce(F.col("transaction_volume"), F.lit(0.0))
    mid0 = at(0, "mid")
    return {
        # base
        "mid": lambda: mid0,
        "micro": lambda: at(0, "micro"),
        "mid60": lambda: at(19, "mid"),
        "micro60": lambda: at(19, "micro"),
        "mid600": lambda: oldest("mid"),
        "d60_mid": lambda: mid0 - at(19, "mid"),
        "d600_mid": lambda: mid0 - oldest("mid"),
        "d60_micro": lambda: at(0, "micro") - at(19, "micro"),
        "book_imb0": lambda: at(0, tilt),
        "book_imb60": lambda: at(19, tilt),
        "d_book_imb": lambda: at(0, tilt) - at(19, tilt),
        "spread0": lambda: at(0, "spread"),
        "spread_mean60": lambda: spread60,
        "mid_vol60": lambda: vol60,
        "mid_vol600": lambda: vol600,
        "range_pos": lambda: F.when(hi > lo, div(mid0 - lo, hi - lo)),
        "curv": lambda: mid0 - 2 * at(19, "mid") + at(39, "mid"),
        "vwap600": lambda: div(A.sum(F.col("transaction_avgprice") * F.col("transaction_volume")), A.sum("transaction_volume")),
        "vol_skew": lambda: F.when((up > 0) & (down > 0), div(up, down)),
        "spread_sqz": lambda: div(at(0, "spread") - spread60, spread60),
        "depth_flow": lambda: imbalance(at(0, depth), at(19, depth)),
        "vol_ratio": lambda: F.when(vol600 > 0, div(vol60, vol600)),
        "micro_imb0": lambda: at(0, "micro") - mid0,
        "micro_imb60": lambda: at(19, "micro") - at(19, "mid"),
        # first extension
        "rel_spread2_0": lambda: at(0, F.when(level2, div(a2 - b2, "mid"))),
        "imb2_0": lambda: at(0, F.when(all_depth > 0, div(bv1 + bv2 - av1 - av2, all_depth))),
        "slope_0": lambda: at(0, F.when(level2, div((a2 - a1) + (b1 - b2), "mid"))),
        "ask_slope_mean60": lambda: ask_slope60,
        "bid_slope_mean60": lambda: bid_slope60,
        "slope_imb60": lambda: bid_slope60 - ask_slope60,
        "m_rv60": lambda: rv60,
        "m_rv600": lambda: rv600,
        "x_rv_60_600": lambda: F.when(rv600 > 0, div(rv60, rv600)),
        # second extension
        "m_mid_last": lambda: at(0, "mid_v"),
        "m_mid_mean": lambda: A.avg("mid_v"),
        "m_mid_std": lambda: A.stddev_samp("mid_v"),
        "m_mid_skew": lambda: A.skewness("mid_v"),
        "m_sp_mean": lambda: A.avg("spread_v"),
        "m_sp_std": lambda: A.stddev_samp("spread_v"),
        "m_imb_mean": lambda: A.avg("imb"),
        "m_imb_std": lambda: A.stddev_samp("imb"),
        "m_imb2_mean60": lambda: favg(F.pow("imb", F.lit(2.0)), s60),
        "m_dofi": lambda: fsum(dofi),
        "m_dofi_60": lambda: fsum(dofi, s60),
        "m_dofi_ewm120": lambda: decayed_mean("dofi", clock, 120),
        "m_mid_ewm30": lambda: decayed_mean("mid_v", clock, 30),
        "m_mid_ewm120": lambda: decayed_mean("mid_v", clock, 120),
        "m_imb_ewm30": lambda: decayed_mean("imb", clock, 30),
        "m_imb_ewm120": lambda: decayed_mean("imb", clock, 120),
        "x_imb_ewm_sl": lambda: decayed_mean("imb", clock, 30) - decayed_mean("imb", clock, 120),
        "x_dofi_ewm_sl": lambda: decayed_mean("dofi", clock, 30) - decayed_mean("dofi", clock, 120),
        "x_mid_zscore": lambda: div(at(0, "mid_v") - A.avg("mid_v"), A.stddev_samp("mid_v") + F.lit(1e-12)),
        "x_sp_imb": lambda: A.avg("spread_v") * A.avg("imb"),
        # third extension
        "m_dofi2_sum60": lambda: fsum(dofi * dofi, s60),
        "m_dofi2_ewm120": lambda: decayed_mean(dofi * dofi, clock, 120),
        "m_mid_ret_abs_mean60": lambda: favg(F.abs("dmid_v"), s60),
        "m_mid_slope_180": lambda: (at(0, "mid_v") - oldest("mid_v", s <= 180)) / 180,
        "m_mid_slope_60": lambda: (at(0, "mid_v") - oldest("mid_v", s60)) / 60,
        "m_imb_mean_15": lambda: imb15,
        "x_imb_15_180": lambda: imb15 - imb180,
        "m_txv_std30": lambda: fstd(txv, s <= 30),
        "m_ask_gap_mean60": lambda: favg(a2 - a1, valid & (a2 > 0) & s60),
        "m_bid_gap_mean60": lambda: favg(b1 - b2, valid & (b2 > 0) & s60),
    }


def factors(tape: Tape, names: Sequence[str]) -> DataFrame:
    """The named book factors, one row per episode with snapshots."""
    exprs, k = aggregates(), tape.key
    plain = [n for n in names if n in exprs]
    parts = [rows(tape).groupBy(k).agg(*[exprs[n]().alias(n) for n in plain])] if plain else []
    ranked = {n: QUANTILES[n] for n in names if n in QUANTILES}
    if ranked:
        booked = with_book(tape.df).select(k, "imb", "spread_v")
        parts.append(quantiles(booked, [k], ranked, hot=tape.hot, limit=tape.limit))
    return reduce(lambda a, b: a.join(b, k, "left"), parts).select(k, *names)
