"""Per-episode trade factors. Rows are read newest-first: a difference is older minus newer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import SPARK, Basic, fcnt, fsum
from ..functions.scalars import decay, div, imbalance, signed
from ..operators.ordered import Tape

PRICE_LAGS = (1, 7, 14, 21, 30)
VOLUME_LAGS = (1, 7, 14, 21)
HALF_WINDOWS = (15, 30, 60)
SIZE_QUANTILES = {"q90": 0.90, "q95": 0.95}


def lags(clock: str) -> dict[str, tuple[str, int]]:
    """name -> (column, rows back) of what `changes` needs."""
    out = {f"_p{n}": ("price", n) for n in PRICE_LAGS}
    out |= {f"_v{n}": ("volume", n) for n in VOLUME_LAGS}
    return out | {"_s1": (clock, 1)}


def changes() -> list[Column]:
    """Differences to newer rows, the gap, the whole second and, last, the sign of the side, from s and the lags."""
    return [
        *[(F.col("price") - F.col(f"_p{n}")).alias(f"dp{n}") for n in PRICE_LAGS],
        *[(F.col("volume") - F.col(f"_v{n}")).alias(f"dv{n}") for n in VOLUME_LAGS],
        (F.col("s") - F.col("_s1")).alias("gap"),
        F.floor("s").cast("int").alias("sec"),
        signed().alias("sgn"),
    ]


def rows(tape: Tape) -> DataFrame:
    """Trades with position, differences and gap. Columns nobody asks for are pruned by Catalyst,
    the window with them."""
    df = tape.ordered(lags=lags(tape.clock))
    return df.select(
        tape.key,
        F.col(tape.clock).alias("s"),
        "price",
        "volume",
        "side",
        "idx",
        "n",
        *[c for c in df.columns if c.startswith(("_p", "_v", "_s1"))],
        *[c for c in ("order_action", "q90", "q95") if c in tape.df.columns],
    ).select("*", *changes())


def recent_imbalance(w: float, A: Basic = SPARK) -> Column:
    """Volume imbalance of the last w seconds."""
    recent = F.col("s") <= w
    return imbalance(A.fsum("volume", (F.col("side") == 0) & recent), A.fsum("volume", (F.col("side") == 1) & recent))


def decayed_imbalance(tau: float, A: Basic = SPARK) -> Column:
    v = F.col("volume") * decay("s", tau)
    return imbalance(A.fsum(v, F.col("side") == 0), A.fsum(v, F.col("side") == 1))


def window_imbalances(windows: Sequence[int] = (2, 5, 10, 15, 30, 60), taus: Sequence[int] = (10, 20, 60)) -> dict[str, Column]:
    """Parameter scan: imbalance by look-back window and by decay constant, and the count imbalance."""
    out = {f"t_imb_{w}s": recent_imbalance(w) for w in windows}
    out |= {f"t_imb_w{t}": decayed_imbalance(t) for t in taus}
    out["t_count_imb"] = imbalance(fcnt(F.col("side") == 0), fcnt(F.col("side") == 1))
    return out


def near_far(prefix: str, kinds: Sequence[str], A: Basic = SPARK) -> dict[str, Callable[[], Column]]:
    """Nearer half of the last w seconds against the farther half, on whole seconds."""

    def ratio(kind: str, w: int) -> Column:
        sec = F.col("sec")
        near, far = sec <= w / 2, (sec > w / 2) & (sec <= w)
        if kind == "price":
            return div(A.favg("price", near), A.favg("price", far)) - 1
        if kind == "vol":
            return div(A.fsum("volume", near), A.fsum("volume", far))
        if kind == "rc":
            return div(A.fcnt(near), A.fcnt(far))
        gone = F.col("order_action") == 1
        return div(A.fcnt(near & gone), A.fcnt(far & gone))

    return {f"{prefix}_{kind}_nf_{w}": partial(ratio, kind, w) for kind in kinds for w in HALF_WINDOWS}


def thirds() -> tuple[Column, Column, Column]:
    """Newer half, newest third, oldest third by position."""
    i, n = F.col("idx"), F.col("n")
    return i * 2 < n, i * 3 < n, i * 3 >= n * 2


def aggregates(A: Basic = SPARK) -> dict[str, Callable[[], Column]]:
    fsum, fcnt, favg = A.fsum, A.fcnt, A.favg
    buy, sell = F.col("side") == 0, F.col("side") == 1
    s, sec, v, p, sgn = F.col("s"), F.col("sec"), F.col("volume"), F.col("price"), F.col("sgn")
    half, third, last_third = thirds()
    pv = sgn * p * v
    near15 = sec <= 15
    big_buy, big_sell = buy & (v > F.col("q90")), sell & (v > F.col("q95"))
    bought, sold = fsum(v, buy), fsum(v, sell)
    buy_size = div(bought, fcnt(buy & (v > 0)))
    sell_size = div(sold, fcnt(sell & (v > 0)))
    recent, distant = fcnt(s <= 15), fcnt(s >= 45)
    newest, oldest = A.max(F.when(F.col("idx") == 0, p)), A.max(F.when(F.col("idx") == F.col("n") - 1, p))
    w15 = decay(s, 15)
    return {
        # base
        "t_imb": lambda: imbalance(bought, sold),
        "t_imb_w30": lambda: decayed_imbalance(30, A),
        "t_imb_w10": lambda: decayed_imbalance(10, A),
        "t_imb_2s": lambda: recent_imbalance(2, A),
        "t_imb_5s": lambda: recent_imbalance(5, A),
        "t_size_imb": lambda: imbalance(buy_size, sell_size),
        "t_vol": lambda: fsum(v),
        "t_n": lambda: A.count("s"),
        "sig_txn": lambda: A.stddev_samp("dp1"),
        "last_gap": lambda: A.min(s),
        "accel": lambda: F.when((recent > 0) & (distant > 0), imbalance(recent, distant)),
        "t_vwap": lambda: A.vwap(),
        # first extension
        "t_buy_ratio": lambda: A.avg(buy.cast("double")),
        "t_buy_ratio_15": lambda: favg(buy.cast("double"), near15),
        "t_n_15": lambda: fcnt(near15),
        "t_large_buy": lambda: fcnt(big_buy),
        "t_large_sell": lambda: fcnt(big_sell),
        "x_large_imb": lambda: div(fcnt(big_buy) - fcnt(big_sell), fcnt(near15) + 1),
        **near_far("t", ("price", "vol", "rc"), A),
        # second extension
        "t_sd": lambda: fsum(pv),
        "t_sd_15": lambda: fsum(pv, near15),
        "t_sd_45": lambda: fsum(pv, sec <= 45),
        "t_px_std": lambda: A.stddev_samp(p),
        "t_px_skew": lambda: A.skewness(p),
        "t_px_last": lambda: newest,
        "t_lv_mean": lambda: A.avg(F.log1p(v)),
        "t_gap_mean": lambda: A.avg("gap"),
        "t_gap_std": lambda: A.stddev_samp("gap"),
        "t_gap_max": lambda: A.max("gap"),
        "t_gap_cv": lambda: div(A.stddev_samp("gap"), A.avg("gap")),
        "t_firsthalf_price": lambda: div(favg(p, half), favg(p, ~half)) - 1,
        "t_firsthalf_buyratio": lambda: favg(buy.cast("double"), half) - favg(buy.cast("double"), ~half),
        "t_firstthird_vol": lambda: div(fsum(v, third), fsum(v, last_third)),
        "t_firstlast_px": lambda: newest - oldest,
        "x_t_signed_ratio": lambda: A.avg(sgn),
        "x_t_signed_w15_diff": lambda: div(fsum(sgn * v * w15, near15), fsum(v * w15, near15)) - favg(sgn, near15),
        "t_pxdiff1_mean": lambda: A.avg("dp1"),
        "t_pxdiff1_std": lambda: A.stddev_samp("dp1"),
        "t_pxdiff7_mean": lambda: A.avg("dp7"),
        "t_pxdiff7_std": lambda: A.stddev_samp("dp7"),
        "t_voldiff1_mean": lambda: A.avg("dv1"),
        "t_voldiff7_mean": lambda: A.avg("dv7"),
        # third extension; the names say 5, the window is 15 s
        "t_sv_5": lambda: fsum(sgn * v, s <= 15),
        "t_sv_60": lambda: fsum(sgn * v),
        "x_t_sv_5_60": lambda: div(fsum(sgn * v, s <= 15), fsum(sgn * v)),
        "t_vol_5": lambda: fsum(v, s <= 15),
        "x_t_vol_5_60": lambda: div(fsum(v, s <= 15), fsum(v)),
        "t_n_60": lambda: A.count("s"),
        "x_tn_15_60": lambda: div(fcnt(s <= 15), A.count("s")),
        "t_sd_ewm45": lambda: fsum(pv * decay(s, 45)),
        "t_buy_sell_vol_ratio": lambda: div(bought, sold + 1),
        "t_large_buy_15": lambda: fcnt(big_buy & (s <= 15)),
        "t_large_sell_15": lambda: fcnt(big_sell & (s <= 15)),
        "x_large_imb_15": lambda: div(fcnt(big_buy & (s <= 15)) - fcnt(big_sell & (s <= 15)), fcnt(s <= 15) + 1),
        "t_pxdiff14_mean": lambda: A.avg("dp14"),
        "t_pxdiff14_std": lambda: A.stddev_samp("dp14"),
        "t_pxdiff21_std": lambda: A.stddev_samp("dp21"),
        "t_pxdiff30_std": lambda: A.stddev_samp("dp30"),
        "t_voldiff14_mean": lambda: A.avg("dv14"),
        "t_voldiff21_mean": lambda: A.avg("dv21"),
    }


def per_second(tape: Tape, prefix: str) -> DataFrame:
    """Two-level factors: the stream is reduced to at most one row per episode and second before
    anything is compared between seconds, so hot episodes shrink map-side."""
    k, s = tape.key, F.col(tape.clock)
    sec = F.floor(s).cast("int").alias("sec")
    grid = tape.df.groupBy(k, sec).agg(
        F.avg("price").alias("px"),
        F.sum(F.when(s <= 30, F.col("volume"))).alias("v30"),
        F.count(F.lit(1)).alias("cnt"),
    )
    w = Window.partitionBy(k).orderBy("sec")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grid = grid.select(
        "*",
        F.avg("px").over(whole).alias("pxm"),
        F.lag("px", 1).over(w).alias("px1"),
        F.lag("px", 5).over(w).alias("px5"),
        (F.col("sec") - F.lag("sec").over(w) - 1).alias("silent"),
        F.sum("cnt").over(Window.partitionBy(k, F.floor(F.col("sec") / 5))).alias("cnt5"),
    )
    dev = F.col("px") - F.col("pxm")

    def autocorr(lagged: str) -> Column:
        return div(fsum(dev * (F.col(lagged) - F.col("pxm"))), F.sum(dev * dev))

    out = {
        f"{prefix}_has_data_15": fcnt(F.col("sec") <= 15),
        f"{prefix}_miss_max": F.greatest(F.min("sec"), 60 - F.max("sec"), F.max("silent")).cast("long"),
        f"{prefix}_vol_max30": F.max("v30"),
    }
    if prefix == "t":
        out |= {"t_autocorr_lag1": autocorr("px1"), "t_autocorr_lag5": autocorr("px5")}
        out["burst5"] = div(F.max("cnt5"), F.sum("cnt"))  # largest share of trades in one 5 s bucket
    return grid.groupBy(k).agg(*[e.alias(c) for c, e in out.items()])


PER_SECOND = {"t_has_data_15", "t_miss_max", "t_vol_max30", "t_autocorr_lag1", "t_autocorr_lag5", "burst5"}


def factors(tape: Tape, names: Sequence[str]) -> DataFrame:
    """The named trade factors, one row per episode with trades. Large-trade counts need the
    threshold columns q90, q95 on the tape (see cross.with_size_thresholds)."""
    exprs, k = aggregates(), tape.key
    plain = [n for n in names if n in exprs]
    parts = [rows(tape).groupBy(k).agg(*[exprs[n]().alias(n) for n in plain])] if plain else []
    if any(n in PER_SECOND for n in names):
        parts.append(per_second(tape, "t").select(k, *[n for n in names if n in PER_SECOND]))
    return reduce(lambda a, b: a.join(b, k, "left"), parts).select(k, *names)
