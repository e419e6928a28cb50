"""Column helpers shared by every plan. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE_BUY, SIDE_SELL = 0, 1
ACTION_NEW, ACTION_CANCEL = 0, 1


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, null where b is zero (ANSI division would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio0(a, b) -> Column:
    """a / b where b > 0, else 0."""
    return F.when(col(b) > 0, div(a, b)).otherwise(F.lit(0.0))


def imbalance(a, b) -> Column:
    return div(col(a) - col(b), col(a) + col(b))


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(float(hi))), F.lit(float(lo)))


def decay(clock, tau: float) -> Column:
    """exp(-s / tau)."""
    return F.exp(-col(clock) / F.lit(float(tau)))


def asinh(x) -> Column:
    """Odd by construction: the built-in loses digits on large negative values."""
    return F.signum(col(x)) * F.asinh(F.abs(col(x)))


def signed(side="side") -> Column:
    """+1 for buy, -1 for sell."""
    return F.when(col(side) == SIDE_BUY, F.lit(1.0)).otherwise(F.lit(-1.0))


def round6(x) -> Column:
    """Six decimals for comparisons. The offset keeps short decimals away from the rounding edge,
    so a different summation order cannot flip the last digit."""
    return F.floor(col(x) * F.lit(1e6) + F.lit(0.4871)).cast("double") / F.lit(1e6)


def round6_all(df: DataFrame, *keep: str) -> DataFrame:
    """round6 on every double column except the named ones."""
    return df.selectExpr(
        *[
            f"cast(floor(`{f.name}` * 1e6D + 0.4871D) as double) / 1e6D as `{f.name}`"
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def nullify_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    return df.selectExpr(
        *[
            f"case when not isnan(`{f.name}`) and abs(`{f.name}`) <> double('infinity') then `{f.name}` end as `{f.name}`"
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )
