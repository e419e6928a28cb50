"""Trades against the last book state at or before them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.aggregates import SPARK, Basic
from ..functions.scalars import div, signed

QUOTES = ("ask_price_1", "bid_price_1", "ask_volume_1", "bid_volume_1")
NAMES = ("imp_depth_60", "imp_depth_5", "spread_cross_frac", "aggr_imb")


def aggregates(clock: str = "s", rows: Column | None = None, state: str = "_state", A: Basic = SPARK) -> dict[str, Column]:
    """Over rows of trades (those where `rows` holds) that have the book state, a struct of QUOTES. A trade over an empty book makes the impact
    undefined for the episode."""
    ask, bid, ask_volume, bid_volume = (F.col(state)[q] for q in QUOTES)
    volume = F.col("volume")
    depth = ask_volume + bid_volume
    impact = div(signed() * volume, depth)
    crossed = (F.col("price") > ask) | (F.col("price") < bid)
    cross = F.when(crossed, F.lit(1.0)).otherwise(F.lit(0.0))
    cross = cross if rows is None else F.when(rows, cross)
    recent = F.col(clock) <= 5
    empty = F.coalesce(depth == 0, F.lit(False))
    return {
        "imp_depth_60": F.when(~A.bool_or(empty), A.fsum(impact)),
        "imp_depth_5": F.when(~A.bool_or(empty & recent), A.fsum(impact, recent)),
        "spread_cross_frac": A.avg(cross),
        "aggr_imb": div(A.sum(signed() * volume * cross), A.sum(volume * cross)),
    }
