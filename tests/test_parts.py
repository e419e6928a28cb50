"""The wide aggregate in parts: same values as one plain aggregate, and no aggregate over rows that is too wide for Spark to compile."""

import re
from functools import reduce

from pyspark.sql import functions as F

from oracle import compare
from tapeframe.functions.aggregates import SPARK
from tapeframe.functions.scalars import div
from tapeframe.operators import parts
from tapeframe.operators.parts import Parts, Terms
from tapeframe.plans import cross, names
from test_dealt import tapes


def factors(A, rows=None):
    """Every kind of aggregate, one of them twice; `rows` picks the kind's rows where both share one aggregate."""
    x = F.col("x") if rows is None else F.when(rows, F.col("x"))
    i = F.col("i") if rows is None else F.when(rows, F.col("i"))
    return {
        "total": A.fsum(x), "mean": A.avg(x), "n": A.count(x), "many": A.fcnt(x > 1), "low": A.min(x), "high": A.max(i).cast("long"), "last": A.max_by(x, i),
        "any": A.bool_or(x > 2), "dev": A.stddev_samp(x), "skew": A.skewness(x), "ratio": div(A.fsum(x), A.stddev_samp(x)),
    }


def test_parts_give_what_one_aggregate_gives(spark, monkeypatch):
    rows = [(k, who, None if (i + who) % 4 == 3 else float(i * i % 7 + who), i) for k in (1, 2, None) for who in (0, 1) for i in range(9) if (k, who) != (2, 1)]
    df = spark.createDataFrame(rows + rows[:3], "k long, who int, x double, i int")
    for buffers in (4, 60):
        monkeypatch.setattr(parts, "BUFFERS", buffers)
        a, b = Terms("_of_a"), Terms("_of_b")
        p = Parts([a, b], {f"a_{n}": c for n, c in factors(a).items()} | {f"b_{n}": c for n, c in factors(b).items()})
        each = [df.where(F.col("who") == who).select("k", "who", *p.columns(who)) for who in (0, 1)]
        both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), each)
        got = p.aggregate(both, "k", F.when(F.col("who") == 0, p.handed(0)).otherwise(p.handed(1)))
        want = df.groupBy("k").agg(
            *[c.alias(f"a_{n}") for n, c in factors(SPARK, F.col("who") == 0).items()], *[c.alias(f"b_{n}") for n, c in factors(SPARK, F.col("who") == 1).items()],
            *[F.nullif(F.count_if(F.col("who") == who), F.lit(0)).alias(f"_rows{who}") for who in (0, 1)],
        )
        here = [c for c in want.columns if c not in ("b_n", "b_many", "b_total")]  # a kind without rows has nulls, not zeros
        assert compare(got.select(here).toPandas(), want.select(here).toPandas()) == ""
        assert compare(got.where("k = 1 or k is null").toPandas(), want.where("k = 1 or k is null").toPandas()) == ""


def test_rows_meet_narrow_aggregates_only(spark):
    market, orders, trades = tapes(spark, None)
    sizes = trades.df.select("sample_id").distinct().select("sample_id", F.lit(1.0).alias("q90"), F.lit(1.0).alias("q95"))
    setting = "spark.sql.debug.maxToStringFields"
    spark.conf.set(setting, "2000")
    try:
        plan = cross.catalogue(market, orders, trades, names.ALL, sizes=sizes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(setting)
    aggregates = [line for line in plan.splitlines() if "HashAggregate" in line]
    first = [a for a in aggregates if "partial_" in a and "_part#" in a.split("functions")[0]]
    assert len(first) == 1 and len(re.findall("partial_", first[0])) < 50
    assert all(len(re.findall("partial_", a)) < 100 for a in aggregates if "_part#" not in a)
    assert "collect_list" not in plan
