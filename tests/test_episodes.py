"""Hand-computed cases on tiny episodes: empty episodes and bins, constant series, equal stamps, short
windows, cropping, collinear controls, order contract."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeframe import schema
from tapeframe.functions import aggregates as A
from tapeframe.functions.scalars import div, nullify_nonfinite
from tapeframe.operators import blend, folds, grid, regression, screening, sequences as S
from tapeframe.operators.ordered import Tape, find_hot
from tapeframe.plans import book, order, trade
from tapeframe.sources import tables


def trades(spark, rows):
    df = spark.createDataFrame(rows, "sample_id long, s double, price double, volume double, side int, seq long")
    return Tape(df, ties=("seq",))


def orders(spark, rows):
    df = spark.createDataFrame(rows, "sample_id long, s double, price double, volume double, side int, order_action int, seq long")
    return Tape(df, ties=("seq",))


def one(df):
    return df.collect()[0].asDict()


def snapshots(spark, rows):
    cols = "sample_id long, s double, ask_price_1 double, bid_price_1 double, ask_price_2 double, bid_price_2 double, ask_volume_1 double, bid_volume_1 double, ask_volume_2 double, bid_volume_2 double, transaction_avgprice double, transaction_volume double"
    return Tape(spark.createDataFrame(rows, cols))


def test_trade_factors_by_hand(spark):
    t = trades(spark, [(1, 0.5, 10.0, 4.0, 0, 0), (1, 3.0, 11.0, 2.0, 1, 1), (1, 20.0, 13.0, 6.0, 0, 2)])
    f = one(trade.factors(t, ["t_imb", "t_imb_2s", "t_imb_5s", "t_size_imb", "t_n", "sig_txn", "last_gap", "accel", "burst5", "t_firstlast_px", "t_miss_max", "t_has_data_15"]))
    assert f["t_imb"] == pytest.approx((10 - 2) / 12)
    assert f["t_imb_2s"] == 1.0 and f["t_imb_5s"] == pytest.approx(2 / 6)
    assert f["t_size_imb"] == pytest.approx((5 - 2) / 7)
    assert f["sig_txn"] == pytest.approx(np.std([1.0, 2.0], ddof=1))
    assert f["last_gap"] == 0.5 and f["accel"] is None and f["burst5"] == pytest.approx(2 / 3)
    assert f["t_firstlast_px"] == -3.0
    assert f["t_miss_max"] == 40 and f["t_has_data_15"] == 2


def test_single_trade_has_null_spread_statistics(spark):
    t = trades(spark, [(1, 2.0, 10.0, 4.0, 1, 0)])
    f = one(trade.factors(t, ["t_imb", "sig_txn", "t_gap_mean", "t_px_std", "t_vol_nf_15", "t_size_imb"]))
    assert f["t_imb"] == -1.0
    assert all(f[c] is None for c in ("sig_txn", "t_gap_mean", "t_px_std", "t_vol_nf_15", "t_size_imb"))


def test_order_flow_signs(spark):
    o = orders(spark, [(1, 1.0, 5.0, 10.0, 0, 0, 0), (1, 2.0, 5.0, 3.0, 0, 1, 1), (1, 3.0, 5.0, 7.0, 1, 0, 2), (1, 4.0, 5.0, 1.0, 1, 1, 3)])
    f = one(order.factors(o, ["ofi", "ofi_norm", "cancel_imb", "patience_diff", "o_cancel_new_ratio"]))
    assert f["ofi"] == 10 - 3 - 7 + 1
    assert f["ofi_norm"] == pytest.approx(1 / 21)
    assert f["cancel_imb"] == pytest.approx((3 - 1) / 4)
    assert f["patience_diff"] == pytest.approx(7 / 13 - 6 / 8)
    assert f["o_cancel_new_ratio"] == pytest.approx(2 / 3)


def test_one_empty_book_row_voids_the_impact(spark):
    from tapeframe.plans.cross import depth_impact

    m = snapshots(spark, [(1, 50.0, 11.0, 9.0, 12.0, 8.0, 1.0, 1.0, 1.0, 1.0, None, None), (1, 10.0, 11.0, 9.0, 12.0, 8.0, 0.0, 0.0, 1.0, 1.0, None, None)])
    t = trades(spark, [(1, 20.0, 10.0, 4.0, 0, 0), (1, 3.0, 12.0, 2.0, 1, 1)])
    f = one(depth_impact(t, m))
    assert f["imp_depth_60"] is None and f["imp_depth_5"] is None
    assert f["spread_cross_frac"] == 0.5 and f["aggr_imb"] == -1.0
    calm = one(depth_impact(trades(spark, [(1, 20.0, 10.0, 4.0, 0, 0)]), m))
    assert calm["imp_depth_60"] == 2.0 and calm["imp_depth_5"] == 0.0


def test_book_positions_and_one_sided_rows(spark):
    rows = [(1, float(i), 11.0 + i, 0.0 if i == 1 else 9.0 + i, 13.0, 7.0, 2.0, 6.0, 1.0, 1.0, None, None) for i in range(3)]
    f = one(book.factors(snapshots(spark, rows), ["mid", "mid60", "mid600", "m_mid_last", "m_mid_mean", "m_rv600", "d_book_imb", "m_imb_q25"]))
    assert f["mid"] == 10.0 and f["mid60"] is None and f["mid600"] == 12.0
    assert f["m_mid_last"] == 10.0 and f["m_mid_mean"] == 11.0
    assert f["m_rv600"] == 0.0  # the one-sided row in between voids both differences
    assert f["d_book_imb"] is None and f["m_imb_q25"] == 0.5


def test_first_and_last_snapshot_one_sided(spark):
    rows = [(1, 30.0, 5.0, 0.0, 6.0, 0.0, 1.0, 1.0, 1.0, 1.0, None, None), (1, 20.0, 7.0, 5.0, 8.0, 4.0, 2.0, 3.0, 1.0, 1.0, 6.5, 2.0), (1, 10.0, 0.0, 4.0, 0.0, 3.0, 1.0, 1.0, 1.0, 1.0, None, None)]
    seq = S.snapshot_sequence(snapshots(spark, rows)).orderBy("pos").collect()
    assert [r.eside for r in seq] == [1.0, 0.0, 1.0]
    assert [r.mid_dev for r in seq] == [0.0, 0.0, 0.0] and [r.spread_n for r in seq] == [1.0, 1.0, 1.0]
    assert seq[0].dt == 1.0 and seq[1].dt == pytest.approx(10 / 30)
    assert seq[1].dpx == pytest.approx(0.25) and seq[0].has_txn == 0.0


def test_episode_without_a_two_sided_book_uses_the_fallback_unit(spark):
    rows = [(1, 30.0, 5.0, 0.0, 6.0, 0.0, 1.0, 1.0, 1.0, 1.0, None, None)]
    idx = one(S.snapshot_index(snapshots(spark, rows), "test"))
    assert idx["U_s"] == 0.0012257 and idx["mid0"] == 1.0 and idx["med_depth"] == 0.0


def test_event_sequence_order_ties_and_sentinel(spark):
    t = trades(spark, [(1, 3.0, 10.0, 2.0, 0, 0), (1, 3.0, 11.0, 4.0, 1, 1), (1, 1.0, 12.0, 600.0, 0, 2)])
    ids = spark.createDataFrame([(1,), (2,)], "sample_id long")
    scale = spark.createDataFrame([(1, 0.5, 10.0)], "sample_id long, U_s double, mid0 double")
    rows = S.event_sequence(t, ids, scale).orderBy("sample_id", "pos").collect()
    assert [r.px_dev for r in rows] == [0.0, 2.0, 4.0, 0.0]
    assert rows[0].dt_log == pytest.approx(math.log1p(3)) and rows[1].dt_log == 0.0 and rows[2].dt_log == pytest.approx(math.log1p(2))
    assert rows[2].vol_rel == pytest.approx(math.asinh(600 / (606 / 60)))
    assert rows[3].n_ev == 0 and rows[3].pos == 0


def test_small_totals_use_one_per_second(spark):
    t = trades(spark, [(1, 3.0, 10.0, 2.0, 0, 0)])
    ids = spark.createDataFrame([(1,)], "sample_id long")
    scale = spark.createDataFrame([(1, None, None)], "sample_id long, U_s double, mid0 double")
    row = one(S.event_sequence(t, ids, scale))
    assert row["vol_rel"] == pytest.approx(math.asinh(2.0)) and row["px_dev"] == 64.0


def test_order_contract_raises(spark):
    bad = trades(spark, [(1, 1.0, 1.0, 1.0, 0, 0), (1, 2.0, 1.0, 1.0, 0, 1), (2, 2.0, 1.0, 1.0, 0, 0)])
    with pytest.raises(ValueError, match="1 rows"):
        S.check_order(bad, "seq")
    S.check_order(trades(spark, [(1, 2.0, 1.0, 1.0, 0, 0), (1, 2.0, 1.0, 1.0, 0, 1), (1, 0.0, 1.0, 1.0, 0, 2)]), "seq")


@pytest.mark.parametrize("size", [2, 5, 224])
def test_crop_keeps_the_newest(spark, size):
    long = spark.createDataFrame([(1, i, 4, float(i + 1)) for i in range(4)], "sample_id long, pos long, n long, x double")
    row = one(S.newest_array(long, ["x"], size))
    got = [v[0] for v in row["x"]]
    if size == 2:
        assert got == [3.0, 4.0] and row["mask"] == [True, True]
    elif size == 5:
        assert got == [0.0, 1.0, 2.0, 3.0, 4.0] and row["mask"] == [False, True, True, True, True]
    else:
        assert got[:4] == [1.0, 2.0, 3.0, 4.0] and set(got[4:]) == {0.0} and len(got) == 224


def cells(spark, t_rows, o_rows=((1, 30.0, 10.0, 1.0, 0, 0, 0),), ids=((1,),)):
    i = spark.createDataFrame(list(ids), "sample_id long")
    return grid.flow_cells(orders(spark, list(o_rows)), trades(spark, list(t_rows)), i)


UNIT = "sample_id long, U_s double"


def test_empty_episode_and_empty_bins(spark):
    c = cells(spark, [(1, 0.2, 10.0, 5.0, 0, 0)], ids=[(1,), (9,)])
    scale = spark.createDataFrame([(1, 0.5), (9, 0.5)], UNIT)
    flow = grid.flow_channels(c, scale)
    empty = flow.where("sample_id = 9")
    assert empty.count() == 60
    assert empty.agg(F.sum("has_event"), F.sum("flow_cnt"), F.max("x_flow_gap")).collect()[0] == (0.0, 0.0, 1.0)
    last = one(flow.where("sample_id = 1 and bin = 59"))
    assert last["t_vol_buy"] == pytest.approx(math.asinh(5.0)) and last["t_imb"] == pytest.approx(5 / (5 + 1e-6))
    assert one(flow.where("sample_id = 1 and bin = 35"))["x_flow_gap"] == pytest.approx(0.6)


def test_signed_run_since_and_peak(spark):
    # oldest to newest: buy, buy, sell, nothing, sell
    t = [(1, 59.5, 1.0, 1.0, 0, 0), (1, 58.5, 1.0, 1.0, 0, 1), (1, 57.5, 1.0, 1.0, 1, 2), (1, 55.5, 1.0, 40.0, 1, 3)]
    d = grid.derived_channels(cells(spark, t), spark.createDataFrame([(1, 0.5)], UNIT)).orderBy("bin").collect()
    assert [round(r.t_imb_run, 3) for r in d[:6]] == [0.1, 0.2, -0.1, 0.0, -0.1, 0.0]
    assert d[3].since_big_txn == 1.0 and d[4].since_big_txn == 0.0 and d[6].since_big_txn == pytest.approx(2 / 30)
    assert {r.t_imb_peak for r in d} == {1.0}


def test_rolling_correlation_window_and_constant_input(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 9, 60).astype(float), rng.random(60)
    df = spark.createDataFrame([(1, i, float(x[i]), float(y[i]), 2.0) for i in range(60)], "sample_id long, bin int, x double, y double, c double")
    got = df.select("bin", grid.rolling_corr(F.col("x"), F.col("y"), "sample_id", 20).alias("r"), grid.rolling_corr(F.col("c"), F.col("y"), "sample_id", 20).alias("z")).orderBy("bin").collect()
    assert all(g.r == 0.0 for g in got[:19]) and all(g.z == 0.0 for g in got)
    for i in range(19, 60):
        assert got[i].r == pytest.approx(np.corrcoef(x[i - 19 : i + 1], y[i - 19 : i + 1])[0, 1])


def test_nonfinite_and_zero_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0), (float("inf"), 2.0), (3.0, 2.0)], "a double, b double")
    got = [r.a for r in nullify_nonfinite(df).collect()]
    assert got == [1.0, None, None, 3.0]
    assert [r[0] for r in df.select(div("b", F.col("b") - 2)).collect()][2:] == [None, None]


def test_pearson_and_cosine_against_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(size=300), "y": rng.normal(size=300)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("c", F.lit(1.0))
    ok = pdf.dropna()
    r = one(df.agg(A.pearson("x", "y").alias("r"), A.pearson("x", "y", 400).alias("few"), A.pearson("c", "y").alias("flat"), A.cosine("x", "y").alias("cos")))
    assert r["r"] == pytest.approx(np.corrcoef(ok.x, ok.y)[0, 1]) and r["few"] is None and r["flat"] is None
    assert r["cos"] == pytest.approx((ok.x * ok.y).sum() / math.sqrt((ok.x**2).sum() * (ok.y**2).sum()))


def test_least_squares_and_residual_against_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(500, 4))
    y = X @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(size=500)
    f = X[:, 0] * 2 + rng.normal(size=500)
    pdf = pd.DataFrame(X, columns=list("abcd")).assign(y=y, f=f, copy=1 + 2 * X[:, 0] - X[:, 1], month=np.arange(500) % 2)
    df = spark.createDataFrame(pdf)
    coef = one(regression.least_squares(df, list("abcd"), "y", intercept=True))["coef"]
    assert coef == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(500), X]), y, rcond=None)[0].tolist())
    per = {r.month: r.coef for r in regression.least_squares(df, list("ab"), "y", keys=["month"]).collect()}
    for m in (0, 1):
        want = np.linalg.lstsq(X[m::2][:, :2], y[m::2], rcond=None)[0]
        assert per[m] == pytest.approx(want.tolist())
    got = {r.factor: r.cos for r in regression.residual_cosine(df, ["f", "copy"], ["a", "b"], "y").collect()}
    A1 = np.column_stack([np.ones(500), X[:, :2]])
    res = f - A1 @ np.linalg.lstsq(A1, f, rcond=None)[0]
    assert got["f"] == pytest.approx((res * y).sum() / math.sqrt((res**2).sum() * (y**2).sum()))
    assert got["copy"] is None


def test_planted_signal_is_kept_and_noise_dropped(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=6000)
    pdf = pd.DataFrame({"sample_id": range(6000), "month": np.arange(6000) % 12, "target": y, "signal": 0.2 * y + rng.normal(size=6000), "noise": rng.normal(size=6000)})
    s = {r.factor: r for r in screening.screen(screening.period_scores(spark.createDataFrame(pdf), ["signal", "noise"])).collect()}
    assert s["signal"].pos_frac == 1.0 and s["signal"].cos_mean > 0.15 > abs(s["noise"].cos_mean)


def test_blend_grid_equals_direct_evaluation(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)), columns=["a", "b", "c", "target"]).assign(month=np.arange(400) % 4)
    g = blend.weight_grid(blend.moments(spark.createDataFrame(pdf), ["a", "b", "c"]), [[0.0, 0.5], [0.0, 1.0, 2.0]]).collect()
    assert len(g) == 4 * 6
    for r in g:
        m = pdf[pdf.month == r.month]
        p = m.a + r.w1 * m.b + r.w2 * m.c
        assert r.cos == pytest.approx((p * m.target).sum() / math.sqrt((p**2).sum() * (m.target**2).sum()))


def test_unit_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(i, 2.0, float(i)) for i in range(4)], "sample_id long, c double, x double")
    rows = blend.unit_columns(df, ["c", "x"]).collect()
    assert all(r.u_c == 0.0 for r in rows)
    assert sum(r.u_x for r in rows) == pytest.approx(0) and sum(r.u_x**2 for r in rows) == pytest.approx(1)


def test_align_raises_on_other_episodes(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "sample_id long, a double")
    b = spark.createDataFrame([(1, 0.1), (3, 0.2)], "sample_id long, b double")
    with pytest.raises(ValueError, match="2 episodes missing"):
        blend.align([a, b])
    assert blend.align([a, a.withColumnRenamed("a", "b")]).count() == 2


def test_fold_statistics_against_numpy(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"sample_id": range(240), "fold": np.arange(240) % 3, "x": rng.normal(size=240), "k": 4.0})
    pdf.loc[::5, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    hot = find_hot(folds.training_rows(df, 3), ["val_fold"], 50)
    for h, lim in ((None, 10**6), (hot, 50)):
        for r in folds.fold_statistics(df, ["x", "k"], 3, hot=h, limit=lim).collect():
            x = pdf.x[pdf.fold != r.val_fold].to_numpy()
            med = np.nanmedian(x)
            filled = np.where(np.isnan(x), med, x)
            assert (r.x_med, r.x_mu, r.x_sd) == pytest.approx((med, filled.mean(), filled.std()))
            assert r.k_sd == 1.0


def test_edges_of_training_folds(spark):
    """All columns and folds against numpy, with and without hot groups; a constant has two edges, a column without values none."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"fold": np.arange(300) % 3, "x": rng.normal(size=300), "t": rng.integers(0, 4, 300).astype(float), "k": 2.0, "none": np.nan})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.select("fold", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "t", "k", "none")])
    hot = find_hot(folds.training_rows(df, 3), ["val_fold"], 50)
    for h, lim in ((None, 10**6), (hot, 50)):
        got = {(r.val_fold, r.factor): r.edges for r in folds.quantile_edges(df, ["x", "t", "k", "none"], 3, bins=8, hot=h, limit=lim).collect()}
        assert set(got) == {(f, c) for f in range(3) for c in ("x", "t", "k")}
        for f in range(3):
            train = pdf[pdf.fold != f]
            assert got[f, "k"] == [1.0, 3.0]
            for c in ("x", "t"):
                assert got[f, c] == pytest.approx(np.unique(np.quantile(train[c].dropna(), np.arange(9) / 8)))
    # one copy of every row, and a plan of one size for any number of columns and bins
    plan = lambda cols, bins: folds.quantile_edges(df, cols, 3, bins=bins, hot=None, limit=10**6)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert plan(["x"], 4) == plan(["x", "t", "k", "none"], 48)


def test_values_far_from_every_quantile_go_before_rows_are_copied_per_fold(spark):
    """The values kept are those whose ranks hold a quantile's neighbours, and few others; the copies per fold come after that filter."""
    for n, bins, first, last in ((1, 4, 0, 4), (2, 2, 1, 1), (7, 48, 0, 48), (1000, 48, 0, 48), (1001, 2, 1, 1), (997, 100, 90, 90)):
        for m in (1, 3):
            rows = spark.range(0, n, m).select(F.col("id").alias("b"), F.least(F.lit(m), F.lit(n) - F.col("id")).alias("m"), F.lit(n).cast("long").alias("n"))
            kept = {r.b for r in rows.where(folds._may_cover(F.col("b"), F.col("m"), F.col("n"), bins, first, last)).collect()}
            places = [(n - 1) * (i / bins) for i in range(first, last + 1)]
            needed = {int(f(p)) // m * m for p in places for f in (math.floor, math.ceil)}
            assert needed <= kept and len(kept) <= 4 * len(places)
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "fold int, x double")
    plan = folds.quantile_edges(df, ["x"], 3, bins=48, hot=None, limit=10**6)._jdf.queryExecution().optimizedPlan().toString()
    copies = plan.index("Generate explode(array(struct(val_fold, 0")
    assert "FLOOR" in plan[copies:]  # the filter is below the copies


def test_more_features_never_fit_the_training_rows_worse(spark):
    """The refit curve's models: a cut chosen among more features has no larger weighted error on the rows it was chosen on."""
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=list("abcd")).assign(sample_id=np.arange(n), fold=np.arange(n) % 2)
    pdf["target"] = 3 * (pdf.b > 0.2) + (pdf.a > 0) + rng.normal(size=n)
    pdf.loc[::9, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    edges = folds.quantile_edges(df, list("abcd"), 2, bins=16, hot=None, limit=10**6)
    data = folds.fold_data(df, list("abcd"), edges, folds.weight_scale(df, 2, 90, hot=None, limit=10**6), [0, 1])
    errors = []
    for some in (["d"], ["c", "d"], ["a", "c", "d"], list("abcd")):
        total = 0.0
        for d in data:
            from pyspark.ml.feature import VectorSlicer

            x = VectorSlicer(inputCol="bins", outputCol="features", indices=[d.features.index(c) for c in some]).transform(d.rows)
            model = folds.boosted_trees(maxIter=1, maxDepth=1).fit(x)
            total += model.transform(x.where("not validates")).agg(F.sum(F.col("weight") * F.pow(F.col("pred") - F.col("target"), F.lit(2.0)))).first()[0]
        errors.append(total)
    assert all(a >= b - 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < 0.8 * errors[0]
    order = spark.createDataFrame([(c, i) for i, c in enumerate("abcd")], "feature string, ordinal int")
    oof, gains = folds.fit_folds(data, maxIter=1, maxDepth=1)
    assert oof.count() == n and [r.feature for r in folds.top_k(folds.mean_gain(gains), order, 1).collect()] == ["b"]
    curve = {r.k: r["mean"] for r in folds.top_k_curve(data, folds.mean_gain(gains), order, [1, 4], maxIter=1, maxDepth=1).collect()}
    assert curve[1] == pytest.approx(curve[4]) and curve[1] > 0.5


def test_schema_check(spark):
    ok = spark.createDataFrame([(1, 2, 0.5)], "sample_id long, month int, target double")
    assert schema.validate_schema(ok, schema.LABEL).columns == ["month", "sample_id", "target"]
    with pytest.raises(ValueError, match="target: expected double, found nothing"):
        schema.validate_schema(ok.drop("target"), schema.LABEL)


def test_file_order_and_period_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0)], "sample_id long, s double").coalesce(1)
    df.write.parquet(str(tmp_path / "a"))
    got = tables.with_file_order(spark.read.parquet(str(tmp_path / "a"))).orderBy("seq").collect()
    assert [(r.s, r.seq) for r in got] == [(2.0, 0), (2.0, 1), (1.0, 2)]
    df.withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "b"))
    both = tables.read_periods(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert both.count() == 6 and both.where("x is null").count() == 3


def test_oof_reader_prefers_the_combined_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "sample_id long, pred double")
    df.write.parquet(str(tmp_path / "f0.parquet"))
    df.write.parquet(str(tmp_path / "f1.parquet"))
    assert tables.read_oof(spark, str(tmp_path)).count() == 2
    df.write.parquet(str(tmp_path / "oof_all.parquet"))
    assert tables.read_oof(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_oof(spark, str(tmp_path / "none"))


def test_streamed_cells_equal_batch(spark, tmp_path):
    from tapeframe.streaming.cells import streamed_cells

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({
        "sample_id": rng.integers(0, 3, 200), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60000, 200), unit="ms"),
        "src": rng.choice(["o", "t"], 200), "price": 1.0, "volume": rng.integers(1, 9, 200).astype(float), "side": rng.integers(0, 2, 200), "action": rng.integers(0, 2, 200),
    })
    df = spark.createDataFrame(pdf)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streamed_cells(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("cells").collect()))
    want = sorted(map(tuple, streamed_cells(df).collect()))
    assert got == want and len(got) > 50
