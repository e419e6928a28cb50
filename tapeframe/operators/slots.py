"""The channels of the 60 x 1 s grid without windows: one array of 60 slots per episode.

A second plan for `grid.flow_channels` and `grid.derived_channels` with the same values. Episode totals and the peak are ordinary
aggregates beside the array, so an episode is one row between one exchange and the final `inline`; what depends on earlier slots
is a scan over the array. Arrays have one entry per bin whatever the number of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, div, ratio0
from .grid import BIG_MULTIPLE, BINS, BURST_BINS, CORR_BINS, DERIVED_CHANNELS, EPS, FLOW_CHANNELS, RUN_CAP, SINCE_CAP


def scan(slots: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states zero, step(zero, x0), step(step(zero, x0), x1), ...: one more than there are slots."""
    return F.aggregate(slots, F.array(zero), lambda states, x: F.concat(states, F.array(step(F.element_at(states, -1), x))))


def last_slots(slots: Column, i: Column, n: int) -> Column:
    """The slots up to position i, n at most."""
    return F.slice(slots, F.greatest(i - (n - 2), F.lit(1)), F.least(i + 1, F.lit(n)))


def correlation(pairs: Column, n: int) -> Column:
    """Pearson correlation of an array of (x, y) with n entries; 0 with fewer and on constant input."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")])

    def add(a: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.struct(
            (a["x"] + x).alias("x"), (a["y"] + y).alias("y"), (a["xx"] + x * x).alias("xx"),
            (a["yy"] + y * y).alias("yy"), (a["xy"] + x * y).alias("xy"),
        )

    def finish(a: Column) -> Column:
        vx = F.greatest(n * a["xx"] - a["x"] * a["x"], F.lit(0.0))
        vy = F.greatest(n * a["yy"] - a["y"] * a["y"], F.lit(0.0))
        return ratio0(n * a["xy"] - a["x"] * a["y"], F.sqrt(vx * vy))

    return F.when(F.size(pairs) >= n, F.aggregate(pairs, zero, add, finish)).otherwise(F.lit(0.0))


def _slots(*columns: str | Column) -> Column:
    return F.sort_array(F.collect_list(F.struct("bin", *columns))).alias("_slots")


def flow_channels(cells: DataFrame, scale: DataFrame, *, key: str = "sample_id", eps: float = EPS) -> DataFrame:
    """The 16 flow channels per (episode, bin), as `grid.flow_channels`."""
    raw = "nb ns cb cs opxv ovol ocnt obcnt tb ts tvol tpxv tcnt tbcnt".split()
    sums = [F.sum(c).alias(f"_{c}") for c in ("nb", "ns", "cb", "cs", "opxv", "ovol", "tpxv", "tvol", "tcnt")]
    wide = cells.groupBy(key).agg(_slots(*raw), *sums).join(scale.select(key, "U_s"), key)
    seen = scan(
        F.col("_slots"), F.lit(-1),
        lambda last, x: F.when(x["ocnt"] + x["tcnt"] > 0, x["bin"]).otherwise(last),
    )
    unit = lambda total: F.greatest(total / BINS, F.lit(1.0))
    base = wide.select(
        key, "U_s", unit(F.col("_nb") + F.col("_ns")).alias("_ou"), unit(F.col("_cb") + F.col("_cs")).alias("_cu"),
        unit(F.col("_tvol")).alias("_tu"), ratio0("_opxv", "_ovol").alias("_ovw"), ratio0("_tpxv", "_tvol").alias("_tvw"),
        ratio0("_tvol", "_tcnt").alias("_tsz"), F.arrays_zip("_slots", F.slice(seen, 2, BINS).alias("_seen")).alias("_z"),
    )
    df = base.select("*", F.inline("_z")).select("*", "_slots.*")

    def dev(pv: str, vol: str, mean: str) -> Column:
        return F.when(F.col(vol) > 0, clip(div(div(pv, vol) - F.col(mean), "U_s"), -50, 50)).otherwise(F.lit(0.0))

    def soft(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / (den + F.lit(eps))).otherwise(F.lit(0.0))

    nb, ns, cb, cs, tb, ts, ocnt, tcnt = (F.col(c) for c in ("nb", "ns", "cb", "cs", "tb", "ts", "ocnt", "tcnt"))
    size = clip(div("tvol", "tcnt") / (F.col("_tsz") + F.lit(EPS)) - 1, -5, 5)
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
        "t_size_rel": F.when(tcnt > 0, size).otherwise(F.lit(0.0)),
        "x_to_buy_diff": F.when((tcnt > 0) & (ocnt > 0), div("tbcnt", "tcnt") - div("obcnt", "ocnt")).otherwise(F.lit(0.0)),
        "x_flow_gap": clip((F.col("bin") - F.col("_seen")).cast("double"), 0, 10) / 10,
        "flow_cnt": F.asinh((ocnt + tcnt).cast("double")),
        "has_event": (ocnt + tcnt > 0).cast("double"),
    }
    return df.select(key, "bin", *[out[c].alias(c) for c in FLOW_CHANNELS])


def derived_channels(cells: DataFrame, scale: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """The 11 derived channels per (episode, bin), as `grid.derived_channels`."""
    cb, cs, nb, ns, tcnt = (F.col(c) for c in ("cb", "cs", "nb", "ns", "tcnt"))
    gap = clip(div(F.col("tsec_max") - F.col("tsec_min"), tcnt - 1), 0, 1)
    alone = [  # channels that need no other slot
        ratio0(cb - cs, cb + cs).alias("o_cancel_imb"),
        ratio0(cb, cb + nb).alias("o_cancel_ratio_buy"),
        ratio0(cs, cs + ns).alias("o_cancel_ratio_sell"),
        ratio0(F.col("big_buy") - F.col("big_sell"), F.col("tvol")).alias("t_big_imb"),
        F.when(tcnt >= 2, gap).otherwise(F.lit(0.0)).alias("t_intragap"),
        "opx_std",
    ]
    cell = cells.select(
        key, "bin", "tvol", "tcnt", "t_maxv", (F.col("ocnt") + tcnt).alias("cnt"), *alone,
        ratio0(F.col("tb") - F.col("ts"), F.col("tb") + F.col("ts")).alias("imb"), ratio0("tpxv", "tvol").alias("vw"),
    )
    values = [c for c in cell.columns if c not in (key, "bin")]
    wide = cell.groupBy(key).agg(
        _slots(*values), ratio0(F.sum("tvol"), F.sum("tcnt")).alias("_vmean"),
        F.max_by("imb", F.struct(F.abs("imb"), -F.col("bin"))).alias("t_imb_peak"),
    )

    slots = F.col("_slots")
    first = F.struct(F.lit(None).cast("double").alias("sign"), F.lit(0).alias("run"), F.lit(-SINCE_CAP).alias("big"))

    def step(a: Column, x: Column) -> Column:
        big = (x["tcnt"] > 0) & (x["t_maxv"] > BIG_MULTIPLE * F.col("_vmean"))
        return F.struct(
            F.signum(x["imb"]).alias("sign"), F.when(F.signum(x["imb"]) == a["sign"], a["run"] + 1).otherwise(F.lit(1)).alias("run"),
            F.when(big, x["bin"]).otherwise(a["big"]).alias("big"),
        )

    def moved(x: Column, i: Column) -> Column:
        change = F.when((x["tvol"] > 0) & (i > 0), F.abs(x["vw"] - F.get(slots, i - 1)["vw"])).otherwise(F.lit(0.0))
        return F.struct(x["tvol"].alias("x"), change.alias("y"))

    wide = wide.withColumns({
        "_state": F.slice(scan(slots, first, step), 2, BINS),
        "_pairs": F.transform(slots, moved),
        "_cnt": F.transform(slots, lambda x: x["cnt"]),
    })
    wide = wide.withColumns({
        "_burst": F.transform("_cnt", lambda _, i: F.array_max(last_slots(F.col("_cnt"), i, BURST_BINS))),
        "_corr": F.transform("_pairs", lambda _, i: correlation(last_slots(F.col("_pairs"), i, CORR_BINS), CORR_BINS)),
    })
    df = wide.join(scale.select(key, "U_s"), key).select(key, "U_s", "t_imb_peak", F.inline(F.arrays_zip("_slots", "_state", "_burst", "_corr")))
    out = {
        "t_imb_run": F.col("_state.sign") * F.least(F.col("_state.run"), F.lit(RUN_CAP)) / F.lit(float(RUN_CAP)),
        "since_big_txn": F.least(F.col("_slots.bin") - F.col("_state.big"), F.lit(SINCE_CAP)) / F.lit(float(SINCE_CAP)),
        "txn_burst_10s": F.asinh(F.col("_burst").cast("double")),
        "t_imb_peak": F.col("t_imb_peak"),
        "vol_px_corr": F.col("_corr"),
        "o_px_disp": clip(div("_slots.opx_std", "U_s"), 0, 50),
    }
    return df.select(key, "_slots.bin", *[out.get(c, F.col(f"_slots.{c}")).alias(c) for c in DERIVED_CHANNELS])
