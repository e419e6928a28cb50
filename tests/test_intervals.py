"""Quantiles of many columns whose values are left where they lie unless their interval holds a wanted rank."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeframe.operators import folds, intervals
from tapeframe.operators.ordered import find_hot


def table(spark):
    rng = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({f"x{i}": rng.normal(size=n) * 10.0**i for i in range(4)} | {"ties": rng.integers(0, 3, n) * 1.0, "zeros": np.where(rng.random(n) < 0.9, -0.0, rng.normal(size=n)), "one": 2.0, "few": np.nan, "none": np.nan})
    pdf.loc[::7, "x1"] = np.nan
    pdf.loc[[5, 17], "few"] = [1.0, 3.0]
    pdf["fold"] = rng.integers(0, 3, n)
    names = [c for c in pdf if c != "fold"]
    return pdf, names, spark.createDataFrame(pdf).select("fold", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names]).repartition(5)


def test_edges_do_not_depend_on_the_intervals(spark, monkeypatch):
    pdf, names, df = table(spark)
    hot = find_hot(folds.training_rows(df, 3), ["val_fold"], 500)
    want = {(k, c): np.unique(np.quantile(v, np.arange(17) / 16)) for k in range(3) for c in names if len(v := pdf.loc[pdf.fold != k, c].dropna())}
    want = {key: e if len(e) > 1 else np.array([e[0] - 1, e[0] + 1]) for key, e in want.items()}
    for cuts, sample in ((1024, 8192), (20, 40), (1, 1)):
        monkeypatch.setattr(intervals, "INTERVALS", cuts)
        monkeypatch.setattr(intervals, "SAMPLE", sample)
        got = {(r.val_fold, r.factor): r.edges for r in folds.quantile_edges(df, names, 3, bins=16, hot=hot, limit=500).collect()}
        assert set(got) == set(want)
        for key, e in want.items():
            assert got[key] == pytest.approx(e), key
        stats = {r.val_fold: r for r in folds.fold_statistics(df, names, 3, hot=hot, limit=500).collect()}
        assert all(stats[k][f"{c}_med"] == pytest.approx(pdf.loc[pdf.fold != k, c].median(), nan_ok=False) for k in range(3) for c in names if (k, c) in want)


def test_few_values_are_handed_on(spark):
    pdf, names, df = table(spark)
    cuts = intervals.cut(df, names, len(pdf))
    train = [intervals.training(n, 3) for n in intervals.counted(df, names, 3, cuts)]
    assert [int(t[0].sum()) for t in train] == [int(pdf.loc[pdf.fold != 0, c].count()) for c in names]
    wanted = [intervals.holding(t, 2, [1]) for t in train]
    kept = intervals.value_counts(df, ["x0"], 3, cuts[:1], wanted[:1])
    assert 2 <= kept.count() < len(pdf) / 50


def test_values_are_not_exchanged_by_column_in_large_folds(spark):
    _, names, df = table(spark)
    hot = find_hot(folds.training_rows(df, 3), ["val_fold"], 500)
    plan = folds.quantile_edges(df, names, 3, bins=16, hot=hot, limit=10**6)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("MapInArrow") == 1
