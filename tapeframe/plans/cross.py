"""Factors that need more than one table, and the joined catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import fsum
from ..functions.scalars import div, nullify_nonfinite, signed
from ..operators.joins import asof_forward, either_hot
from ..operators.ordered import Tape
from ..operators.quantiles import quantiles
from . import book, depth, names, order, shared, trade


def size_thresholds(trades: Tape, months: DataFrame | None, hot) -> DataFrame:
    """Nearest-rank 90 % and 95 % trade volume per period, or over the whole table without `months`."""
    specs = {name: ("volume", q, "nearest") for name, q in trade.SIZE_QUANTILES.items()}
    if months is None:
        return quantiles(trades.df.select("volume", F.lit(0).alias("_all")), ["_all"], specs, hot=hot, limit=trades.limit)
    rows = trades.df.select(trades.key, "volume").join(months, trades.key)
    return quantiles(rows, ["month"], specs, hot=hot, limit=trades.limit)


def episode_thresholds(trades: Tape, months: DataFrame | None, thresholds: DataFrame) -> DataFrame:
    """(key, q90, q95) per episode. The threshold table has one row per period (or one row), which bounds its broadcast."""
    if months is None:
        return trades.df.select(trades.key).distinct().crossJoin(F.broadcast(thresholds.drop("_all")))
    return months.join(F.broadcast(thresholds), "month").select(trades.key, "q90", "q95")


def with_size_thresholds(trades: Tape, months: DataFrame | None, thresholds: DataFrame) -> Tape:
    """Adds q90, q95 to every trade. The threshold table has one row per period (or one row), which
    bounds its broadcast."""
    if months is None:
        return trades.map(lambda df: df.crossJoin(F.broadcast(thresholds.drop("_all"))))
    per_episode = months.join(F.broadcast(thresholds), "month").drop("month")
    return trades.map(lambda df: df.join(per_episode, trades.key, "left"))


def depth_impact(trades: Tape, market: Tape) -> DataFrame:
    """Trades against the last book state at or before them."""
    j = asof_forward(trades, market, depth.QUOTES).withColumn("_state", F.struct(*depth.QUOTES))
    return j.groupBy(trades.key).agg(*[c.alias(n) for n, c in depth.aggregates(trades.clock).items()])


# what a cross factor is made of: name -> (book inputs, trade inputs, order inputs)
INPUTS = {
    "vwap_dev60": (["mid"], ["t_vwap"], []),
    "vwap_dev600": (["mid", "vwap600"], [], []),
    "x_to_buy_diff": ([], ["t_buy_ratio"], ["o_buy_ratio"]),
    "x_to_buy_diff_15": ([], ["t_buy_ratio_15"], ["o_buy_ratio_15"]),
    "x_vwap_mid_ratio": (["m_mid_last"], ["t_vwap"], []),
    "x_trans_order_vol_ratio": ([], ["t_vol"], ["o_vol"]),
}


def _definitions():
    return {
        "vwap_dev60": F.col("mid") - F.col("t_vwap"),
        "vwap_dev600": F.col("mid") - F.col("vwap600"),
        "x_to_buy_diff": F.col("t_buy_ratio") - F.col("o_buy_ratio"),
        "x_to_buy_diff_15": F.col("t_buy_ratio_15") - F.col("o_buy_ratio_15"),
        "x_vwap_mid_ratio": div(F.col("t_vwap") - F.col("m_mid_last"), "m_mid_last"),
        "x_trans_order_vol_ratio": div("t_vol", "o_vol"),
    }


@cache
def _known() -> tuple[frozenset[str], ...]:
    """The factors of snapshots, trades and orders."""
    return (
        frozenset({*book.aggregates(), *book.QUANTILES}),
        frozenset({*trade.aggregates(), *trade.PER_SECOND}),
        frozenset({*order.aggregates(), *order.PER_SECOND}),
    )


def _by_table(market: Tape, orders: Tape, trades: Tape, b, t, o, d) -> DataFrame:
    """The wide table from plans that can split an episode over tasks."""
    k = market.key
    df = book.factors(market, b)
    if t:
        df = df.join(trade.factors(trades, t), k, "left")
    if d:
        df = df.join(depth_impact(trades, market).select(k, *d), k, "left")
    if o:
        df = df.join(order.factors(orders, o), k, "left")
    return df


def catalogue(market: Tape, orders: Tape, trades: Tape, wanted: Sequence[str] = tuple(names.ALL), *, sizes: DataFrame | None = None) -> DataFrame:
    """One row per episode with snapshots and one column per wanted factor. Large-trade factors need their thresholds, as `sizes` (key, q90, q95)
    or as columns of the trades.

    Each source table is scanned once, and all rows are exchanged once (plans/shared.py). Hot episodes are taken out of all three tables and go through
    plans of their own, which split an episode."""
    pairs = dict(zip(names.PAIR_NAMES, names.PAIRS))
    need = list(dict.fromkeys(x for w in wanted for x in pairs.get(w, (w,))))
    inputs = [INPUTS.get(w) for w in need]
    b, t, o = (
        list(dict.fromkeys([w for w in need if w not in INPUTS and w in known] + [x for i in inputs if i for x in i[p]]))
        for p, known in enumerate(_known())
    )
    b = b or ["mid"]
    d = [w for w in need if w in depth.NAMES]
    k = market.key
    hot = either_hot(either_hot(market.hot, orders.hot, k), trades.hot, k)
    if hot is None:
        df = shared.episode_factors(market, trades, orders, sizes, b, t, o, d)
    else:
        marked = F.broadcast(hot.keys.select(k).distinct())
        cold = [replace(x, df=x.df.join(marked, k, "left_anti"), hot=None) for x in (market, orders, trades)]
        warm = [replace(x, df=x.df.join(marked, k, "left_semi")) for x in (market, orders, trades)]
        few = None if sizes is None else sizes.join(marked, k, "left_anti")
        if sizes is not None:
            warm[2] = warm[2].map(lambda x: x.join(F.broadcast(sizes.join(marked, k, "left_semi")), k, "left"))
        df = shared.episode_factors(cold[0], cold[2], cold[1], few, b, t, o, d)
        df = df.unionByName(_by_table(*warm, b, t, o, d).select(*df.columns))
    defs = _definitions()
    df = df.select("*", *[defs[w].alias(w) for w in need if w in defs and w not in df.columns])
    df = df.select("*", *[(F.col(x) * F.col(y)).alias(p) for p, (x, y) in pairs.items() if p in wanted])
    silent = {"t_has_data_15": 0, "t_miss_max": 61, "o_has_data_15": 0, "o_miss_max": 61}
    df = df.na.fill({c: v for c, v in silent.items() if c in df.columns})
    return nullify_nonfinite(df.select(k, *wanted))


def with_volatility_products(df: DataFrame, columns=("t_imb", "ofi", "ofi_norm", "t_imb_w30", "t_imb_2s")) -> DataFrame:
    """Imbalance factors scaled by trade and book volatility."""
    return df.select(
        "*",
        *[(F.col(c) * F.col("sig_txn")).alias(f"{c}_x_sig") for c in columns],
        *[(F.col(c) * F.col("mid_vol60")).alias(f"{c}_x_mv60") for c in columns],
    )


def with_spread_ratios(df: DataFrame, columns=("t_imb_2s", "t_imb_5s", "t_imb_w10", "ofi_w10_norm")) -> DataFrame:
    return df.select("*", *[div(c, "spread0").alias(f"{c}_div_spread") for c in columns])
