"""Explicit table schemas and a check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KEY = [T.StructField("sample_id", T.LongType()), T.StructField("seconds_before_predict", T.DoubleType())]
_EVENT = [
    *_KEY,
    T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("side", T.ByteType()),
]

TRADE = T.StructType(_EVENT)
ORDER = T.StructType([*_EVENT, T.StructField("order_action", T.ByteType())])
MARKET = T.StructType(
    [
        *_KEY,
        *[
            T.StructField(f"{side}_{what}_{level}", T.DoubleType())
            for level in (1, 2)
            for what in ("price", "volume")
            for side in ("ask", "bid")
        ],
        T.StructField("transaction_avgprice", T.DoubleType()),
        T.StructField("transaction_volume", T.DoubleType()),
    ]
)
LABEL = T.StructType(
    [
        T.StructField("month", T.IntegerType()),
        T.StructField("sample_id", T.LongType()),
        T.StructField("target", T.DoubleType()),
    ]
)
IDS = T.StructType([T.StructField("sample_id", T.LongType())])


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Raises when a column is missing or has another type; returns the expected columns in order."""
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [
        f"{f.name}: expected {f.dataType.simpleString()}, found {have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in expected.fields
        if have.get(f.name) != f.dataType
    ]
    if bad:
        raise ValueError("; ".join(bad))
    return df.select(*expected.fieldNames())
