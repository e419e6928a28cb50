"""The plan for hot episodes must give exactly the values of the plain window plan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeframe.operators import joins, quantiles as Q
from tapeframe.operators.ordered import Tape, find_hot, newest_rows, oldest_row, ordered

LIMIT = 7


def tape_frame(spark, seed=0, sizes=(1, 5, 7, 8, 40, 211)):
    """Ties in the clock, nulls in x, one episode with most of the rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, m in enumerate(sizes):
        for i in range(m):
            rows.append((k, float(rng.integers(0, 12)) * 5, i, None if rng.random() < 0.4 else float(rng.integers(0, 9)), float(rng.integers(1, 6))))
    pdf = pd.DataFrame(rows, columns=["sample_id", "s", "seq", "x", "v"]).sample(frac=1, random_state=seed)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df.repartition(5)


def as_rows(df, by):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("newest", [True, False])
def test_hot_plan_equals_window_plan(spark, newest):
    df = tape_frame(spark)
    state = dict(
        lags={"l1": ("v", 1), "l5": ("x", 5)}, fills={"fx": "x"}, firsts={"hx": "x"}, sums={"sv": "v"}
    )
    plain = Tape(df, ties=("seq",)).ordered(newest=newest, **state)
    split = Tape.of(df, ties=("seq",), limit=LIMIT)
    assert split.hot is not None and split.hot.rows == 8 + 40 + 211
    assert as_rows(split.ordered(newest=newest, **state), "seq") == as_rows(plain, "seq")


def test_reach_longer_than_limit(spark):
    df = tape_frame(spark, 3)
    lags = {"l30": ("v", 30)}
    plain = Tape(df, ties=("seq",)).ordered(lags=lags)
    split = Tape.of(df, ties=("seq",), limit=LIMIT).ordered(lags=lags)
    assert as_rows(split, "seq") == as_rows(plain, "seq")


def test_no_hot_group_found(spark):
    assert find_hot(tape_frame(spark), ["sample_id"], 1000) is None


@pytest.mark.parametrize("q,method", [(0.5, "linear"), (0.25, "nearest"), (0.9, "nearest"), (0.37, "linear"), (0.0, "linear"), (1.0, "nearest")])
def test_quantiles_against_numpy(spark, q, method):
    df = tape_frame(spark, 1)
    hot = find_hot(df, ["sample_id"], LIMIT)
    spec = {"q": ("x", q, method)}
    got = dict(Q.quantiles(df, ["sample_id"], spec, hot=hot, limit=LIMIT).collect())
    plain = dict(Q.quantiles(df, ["sample_id"], spec, hot=None).collect())
    for k, g in df.toPandas().groupby("sample_id"):
        x = np.sort(g.x.dropna().to_numpy())
        if not len(x):
            want = None
        elif method == "linear":
            want = np.quantile(x, q)
        else:
            want = x[int(np.floor((len(x) - 1) * q + 0.5))]
        assert got[k] == pytest.approx(want) and plain[k] == pytest.approx(want)


def test_average_rank_and_auc_against_naive(spark):
    df = tape_frame(spark, 2).withColumn("pos", F.col("v") > 3)
    hot = find_hot(df, ["sample_id"], LIMIT)
    ranked = Q.with_rank(df, ["sample_id"], "x", "r", hot=hot, limit=LIMIT).toPandas()
    for _, g in ranked.groupby("sample_id"):
        want = g.x.rank(method="average")
        assert (g.r.fillna(-1) == want.fillna(-1)).all()
    scored = df.where(F.col("x").isNotNull())
    got = dict(Q.auc(scored, "x", "pos", hot=hot, keys=["sample_id"], limit=LIMIT).collect())
    for k, g in scored.toPandas().groupby("sample_id"):
        p, n = g.x[g.pos].to_numpy(), g.x[~g.pos].to_numpy()
        if len(p) and len(n):
            want = ((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])).mean()
            assert got[k] == pytest.approx(want)
        else:
            assert got[k] is None


def test_ranks_of_many_columns_in_one_pass(spark):
    df = tape_frame(spark, 12).withColumn("y", F.when(F.col("v") > 1, F.col("v"))).withColumn("one", F.lit(1))
    df = df.withColumn("sample_id", F.when(F.col("sample_id") != 2, F.col("sample_id")))
    hot = find_hot(df.where("sample_id is not null"), ["sample_id"], LIMIT)
    specs = {"rx": ("x", False), "nx": ("x", True), "ry": ("y", True), "rs": ("s", False), "r1": ("one", True)}
    split = Q.with_ranks(df, ["sample_id"], specs, hot=hot, limit=LIMIT, min_rows=6)
    plain = Q.with_ranks(df, ["sample_id"], specs, hot=None, min_rows=6)
    assert as_rows(split, "seq") == as_rows(plain, "seq")
    joins = lambda out: str(out._jdf.queryExecution().optimizedPlan()).count("Join ")
    few = Q.with_ranks(df, ["sample_id"], {"rx": ("x", False)}, hot=hot, limit=LIMIT)
    assert joins(split) == joins(few)


def test_quantiles_of_many_columns_with_a_hot_list_of_another_table(spark):
    df = tape_frame(spark, 13).withColumn("none", F.lit(None).cast("double"))
    hot = find_hot(df.unionByName(df.withColumn("sample_id", F.lit(99).cast("long"))), ["sample_id"], LIMIT)
    specs = {"a": ("x", 0.3, "linear"), "b": ("seq", 0.5, "nearest"), "c": ("none", 0.5, "linear"), "d": ("v", 0.9, "linear"), "e": ("x", 0.8, "nearest")}
    got = Q.quantiles(df, ["sample_id"], specs, hot=hot, limit=LIMIT)
    want = Q.quantiles(df, ["sample_id"], specs, hot=None)
    assert got.schema == want.schema
    for g, w in zip(got.orderBy("sample_id").collect(), want.orderBy("sample_id").collect(), strict=True):
        assert list(g) == pytest.approx(list(w))


def test_asof_forward_against_brute_force(spark):
    trades = tape_frame(spark, 4).withColumn("s", F.col("s") + F.col("seq") % 3)
    snaps = tape_frame(spark, 5, (3, 2, 30, 1, 60, 90)).withColumn("book", F.col("seq").cast("double"))
    for limit in (LIMIT, 10**6):
        a = Tape.of(trades, ties=("seq",), limit=limit)
        b = Tape.of(snaps, ties=("seq",), limit=limit)
        got = joins.asof_forward(a, b, ["book"]).toPandas()
        sn = snaps.toPandas()
        assert len(got) == trades.count()
        for _, r in got.iterrows():
            c = sn[(sn.sample_id == r.sample_id) & (sn.s >= r.s)].sort_values(["s", "seq"])
            want = c.iloc[0].book if len(c) else None
            assert (pd.isna(r.book) and want is None) or r.book == want


def test_nearest_present_against_brute_force(spark):
    df = tape_frame(spark, 6)
    hs = [0.0, 12.0, 26.0, 60.0]
    for limit in (LIMIT, 10**6):
        got = joins.nearest_present(Tape.of(df, ties=("seq",), limit=limit), hs, "x")
        got = {(r.sample_id, r.h): (r.now, r.then) for r in got.collect()}
        want = {}
        for k, g in df.toPandas().sort_values(["s", "seq"]).groupby("sample_id"):
            s, x = g.s.to_numpy(), g.x.to_numpy()
            now = next((v for v in x if not np.isnan(v)), None)
            for h in hs:
                j = int(np.argmin(np.abs(s - h)))
                order = [j] + [i for d in range(1, 5) for i in (j + d, j - d)]
                hit = next((x[i] for i in order if 0 <= i < len(x) and not np.isnan(x[i])), None)
                if now is not None and hit is not None:
                    want[(k, h)] = (now, hit)
        assert got == want


def test_state_match_against_brute_force(spark):
    a = tape_frame(spark, 7, (4, 9, 1)).dropDuplicates(["sample_id", "s"]).withColumn("x", F.coalesce("x", F.lit(0.0)))
    b = tape_frame(spark, 8, (6, 12, 3)).dropDuplicates(["sample_id", "s"]).withColumn("x", F.coalesce("x", F.lit(0.0)))
    a, b = (spark.createDataFrame(t.toPandas()) for t in (a, b))
    shifts = [2.0, 5.0, 10.0, 17.0]
    got = joins.state_match(Tape(a, ties=("seq",)), Tape(b, ties=("seq",)), ["x"], shifts)
    got = {(r.sample_id, r.d): (r.rows, r.matched) for r in got.collect()}
    want = {}
    pb = b.toPandas().sort_values("s")
    for _, r in a.toPandas().iterrows():
        o = pb[pb.sample_id == r.sample_id]
        for d in shifts:
            t = r.s + d
            if len(o) and o.s.min() <= t <= o.s.max():
                j = (o.s - t).abs().to_numpy().argmin()
                n, m = want.get((r.sample_id, d), (0, 0))
                want[(r.sample_id, d)] = (n + 1, m + int(o.x.iloc[j] == r.x))
    assert got == want


def test_newest_and_oldest_rows(spark):
    df = tape_frame(spark, 9)
    tape = Tape(df, ties=("seq",))
    pdf = df.toPandas().sort_values(["sample_id", "s", "seq"])
    got = newest_rows(tape, 3).select("sample_id", "seq").toPandas()
    want = pdf.groupby("sample_id").head(3)
    assert set(map(tuple, got.values)) == set(map(tuple, want[["sample_id", "seq"]].values))
    got = oldest_row(tape).select("sample_id", "seq").toPandas()
    want = pdf.groupby("sample_id").tail(1)
    assert set(map(tuple, got.values)) == set(map(tuple, want[["sample_id", "seq"]].values))


def test_order_does_not_depend_on_partitioning(spark):
    df = tape_frame(spark, 10)
    a = Tape(df.repartition(1), ties=("seq",)).ordered(lags={"l": ("v", 1)})
    b = Tape(df.repartition(17), ties=("seq",)).ordered(lags={"l": ("v", 1)})
    assert as_rows(a, "seq") == as_rows(b, "seq")


def test_global_group(spark):
    df = tape_frame(spark, 11).withColumn("_all", F.lit(0))
    hot = find_hot(df, ["_all"], LIMIT)
    order = [F.col(c).asc() for c in ("s", "sample_id", "seq")]
    out = ordered(df, ["_all"], order, hot=hot, limit=LIMIT).orderBy("idx").toPandas()
    assert list(out.idx) == list(range(len(out)))
    assert list(out.s) == sorted(out.s)
