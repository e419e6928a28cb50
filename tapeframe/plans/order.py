"""Per-episode order factors. Rows are read newest-first."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import SPARK, Basic
from ..functions.scalars import decay, div, imbalance
from ..operators.ordered import Tape
from .trade import near_far, per_second, rows, thirds

PER_SECOND = {"o_has_data_15", "o_miss_max", "o_vol_max30"}


def flow_sign() -> Column:
    """+1 where an order adds buying pressure (new buy, cancelled sell), else -1."""
    return F.when((F.col("side") == 0) == (F.col("order_action") == 0), F.lit(1.0)).otherwise(F.lit(-1.0))


def aggregates(A: Basic = SPARK) -> dict[str, Callable[[], Column]]:
    fsum, fcnt, favg = A.fsum, A.fcnt, A.favg
    buy, sell = F.col("side") == 0, F.col("side") == 1
    new, gone = F.col("order_action") == 0, F.col("order_action") == 1
    s, sec, v, p, sgn = F.col("s"), F.col("sec"), F.col("volume"), F.col("price"), F.col("sgn")
    act = F.when(new, F.lit(1.0)).otherwise(F.lit(-1.0))
    flow = flow_sign() * v
    half, third, last_third = thirds()
    buy_gone, sell_gone = fsum(v, buy & gone), fsum(v, sell & gone)
    buy_new, sell_new = fsum(v, buy & new), fsum(v, sell & new)
    e30, e10 = decay(s, 30), decay(s, 10)
    return {
        # base
        "ofi": lambda: fsum(flow),
        "ofi_w30": lambda: fsum(flow * e30),
        "ofi_w10": lambda: fsum(flow * e10),
        "ofi_norm": lambda: div(fsum(flow), fsum(v)),
        "ofi_w30_norm": lambda: div(fsum(flow * e30), fsum(v * e30)),
        "ofi_w10_norm": lambda: div(fsum(flow * e10), fsum(v * e10)),
        "ofi_5s": lambda: A.sum(F.when(s <= 5, flow)),
        "o_vol": lambda: fsum(v),
        "o_n": lambda: A.count(F.lit(1)),
        "cancel_imb": lambda: imbalance(buy_gone, sell_gone),
        "patience_diff": lambda: imbalance(buy_new, buy_gone) - imbalance(sell_new, sell_gone),
        # first extension
        "o_buy_ratio": lambda: A.avg(buy.cast("double")),
        "o_buy_ratio_15": lambda: favg(buy.cast("double"), sec <= 15),
        **near_far("o", ("vol", "rc", "cancel"), A),
        # second extension
        "o_px_std": lambda: A.stddev_samp(p),
        "o_px_skew": lambda: A.skewness(p),
        "o_bid_depth": lambda: fsum(v, buy),
        "o_ask_depth": lambda: fsum(v, sell),
        "o_sv": lambda: fsum(sgn * v),
        "o_av": lambda: fsum(act * v),
        "o_gap_mean": lambda: A.avg("gap"),
        "o_gap_std": lambda: A.stddev_samp("gap"),
        "o_gap_cv": lambda: div(A.stddev_samp("gap"), A.avg("gap")),
        "o_cancel_new_ratio": lambda: div(fcnt(gone), fcnt(new) + 1),
        "o_firsthalf_price": lambda: div(favg(p, half), favg(p, ~half)) - 1,
        "o_firstthird_vol": lambda: div(fsum(v, third), fsum(v, last_third)),
        "o_pxdiff1_mean": lambda: A.avg("dp1"),
        "o_pxdiff1_std": lambda: A.stddev_samp("dp1"),
        "o_pxdiff7_std": lambda: A.stddev_samp("dp7"),
        "o_voldiff1_mean": lambda: A.avg("dv1"),
        # third extension
        "o_sv_ewm15": lambda: fsum(sgn * v * decay(s, 15)),
        "o_av_ewm45": lambda: fsum(act * v * decay(s, 45)),
        "o_add_ratio": lambda: A.avg(new.cast("double")),
        "o_pxdiff14_std": lambda: A.stddev_samp("dp14"),
        "o_voldiff14_mean": lambda: A.avg("dv14"),
    }


def factors(tape: Tape, names: Sequence[str]) -> DataFrame:
    exprs, k = aggregates(), tape.key
    plain = [n for n in names if n in exprs]
    parts = [rows(tape).groupBy(k).agg(*[exprs[n]().alias(n) for n in plain])] if plain else []
    if any(n in PER_SECOND for n in names):
        parts.append(per_second(tape, "o").select(k, *[n for n in names if n in PER_SECOND]))
    return reduce(lambda a, b: a.join(b, k, "left"), parts).select(k, *names)
