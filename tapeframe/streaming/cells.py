"""The per-second flow aggregates on a stream of order and trade events. Late events are taken up to the
watermark; state is one partial row per open (episode, second)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import fsum


def streamed_cells(events: DataFrame, *, late: str = "10 seconds", key: str = "sample_id") -> DataFrame:
    """events(key, ts, src 'o'|'t', price, volume, side, action) -> one row per (key, second)."""
    order, buy, sell = F.col("src") == "o", F.col("side") == 0, F.col("side") == 1
    new, gone = order & (F.col("action") == 0), order & (F.col("action") == 1)
    trade = F.col("src") == "t"
    cells = events.withWatermark("ts", late).groupBy(key, F.window("ts", "1 second")).agg(
        fsum("volume", new & buy).alias("nb"),
        fsum("volume", new & sell).alias("ns"),
        fsum("volume", gone & buy).alias("cb"),
        fsum("volume", gone & sell).alias("cs"),
        F.count_if(order).alias("ocnt"),
        fsum("volume", trade & buy).alias("tb"),
        fsum("volume", trade & sell).alias("ts"),
        fsum(F.col("price") * F.col("volume"), trade).alias("tpxv"),
        F.count_if(trade).alias("tcnt"),
    )
    return cells.select(key, F.col("window.start").alias("second"), *[c for c in cells.columns if c not in (key, "window")])
