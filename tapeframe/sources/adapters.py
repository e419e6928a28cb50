"""The benchmark tables seen as episodes: one episode = one supplier and one ship year, the clock
counts down the days to 31 December, a period is a group of suppliers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import DEFAULT_LIMIT, Hot, Tape, find_hot
from .shared import settle

TIES = ("l_orderkey", "l_linenumber", "l_partkey")
ORDER_SECONDS, MARKET_SECONDS = 60.0, 600.0
RANKED_COLUMNS = 8


@dataclass(frozen=True)
class Episodes:
    """The four event tables of one scale factor. Hot episodes are looked for once per table."""

    spark: SparkSession
    folder: str
    limit: int = DEFAULT_LIMIT

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        ship = F.col("l_shipdate").cast("date")
        return self.table("lineitem").select(
            (F.col("l_suppkey") * 10 + (F.year(ship) - 1995)).alias("sample_id"),
            F.datediff(F.make_date(F.year(ship), F.lit(12), F.lit(31)), ship).alias("d"),
            "l_suppkey",
            *TIES,
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity")) / F.lit(1e3)).alias("px"),
            F.col("l_quantity").alias("volume"),
            "l_discount",
            "l_tax",
            F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("side"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("order_action"),
        )

    @cached_property
    def _events(self) -> int:
        """Number of events, from the file footers; no table has more snapshots than that."""
        return self.table("lineitem").count()

    @cached_property
    def _hot_events(self) -> Hot | None:
        return find_hot(self.base.select("sample_id"), ["sample_id"], self.limit)

    @cached_property
    def _hot_snapshots(self) -> Hot | None:
        """An episode has at most one snapshot per day, so none can pass a limit of 366 rows or more."""
        if self.limit >= 366:
            return None
        return find_hot(self.base.select("sample_id", "d").distinct(), ["sample_id"], self.limit)

    @cached_property
    def trade(self) -> Tape:
        df = self.base.select(
            "sample_id", _clock(ORDER_SECONDS), F.col("px").alias("price"), "volume", "side", *TIES
        )
        return Tape(df, ties=TIES, limit=self.limit, hot=self._hot_events, rows=self._events)

    @cached_property
    def order(self) -> Tape:
        price = F.floor(F.col("px") * (F.lit(1.0) - F.col("l_discount")) * F.lit(1e3)) / F.lit(1e3)
        df = self.base.select(
            "sample_id", _clock(ORDER_SECONDS), price.alias("price"), "volume", "side", "order_action", *TIES
        )
        return Tape(df, ties=TIES, limit=self.limit, hot=self._hot_events, rows=self._events)

    @cached_property
    def market(self) -> Tape:
        no_bid = F.col("d") % 97 == 5
        traded = F.col("d") % 11 != 3
        lo, hi, vol = F.min("px"), F.max("px"), F.sum("volume")
        df = (
            self.base.groupBy("sample_id", "d")
            .agg(
                (hi + F.lit(0.001)).alias("ask_price_1"),
                F.when(no_bid, F.lit(0.0)).otherwise(lo - F.lit(0.001)).alias("bid_price_1"),
                (hi + F.lit(0.002)).alias("ask_price_2"),
                F.when(no_bid, F.lit(0.0)).otherwise(lo - F.lit(0.003)).alias("bid_price_2"),
                F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("volume"))), F.lit(0.0)).alias("ask_volume_1"),
                F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("volume"))), F.lit(0.0)).alias("bid_volume_1"),
                vol.alias("ask_volume_2"),
                (vol + F.lit(10.0)).alias("bid_volume_2"),
                F.when(traded, F.avg("px")).alias("transaction_avgprice"),
                F.when(traded, vol).alias("transaction_volume"),
            )
            .withColumn("s", F.lit(MARKET_SECONDS) * F.col("d") / F.lit(366))
            .drop("d")
        )
        return Tape(df, limit=self.limit, hot=self._hot_snapshots, rows=self._events)

    @cached_property
    def label(self) -> DataFrame:
        return (
            self.base.groupBy("sample_id", "l_suppkey")
            .agg((F.avg("l_tax") - F.avg("l_discount")).alias("target"))
            .select("sample_id", (F.col("l_suppkey") % 12).cast("int").alias("month"), "target")
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Three stand-in members of an ensemble: fixed formulas per episode, with label and scale."""
        sgn = F.when(F.col("side") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        members = self.trade.df.groupBy("sample_id").agg(
            (F.avg("price") - F.lit(2.0)).alias("p_a"), F.sum(sgn * F.col("volume")).alias("p_b"), F.max("price").alias("p_c")
        )
        return self.label.join(members, "sample_id")

    @cached_property
    def months(self) -> DataFrame:
        """sample_id, month without reading more than the keys; settled, as thresholds, folds and limits all ask for it."""
        return settle(self.base.select("sample_id", (F.col("l_suppkey") % 12).cast("int").alias("month")).distinct())

    @cached_property
    def calendar(self) -> DataFrame:
        """Every supplier and year 1995-2002 as episode ids; some of them have no events."""
        years = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")
        return self.table("supplier").select("s_suppkey", years).select((F.col("s_suppkey") * 10 + F.col("y")).alias("sample_id"))

    @cached_property
    def hot_months(self) -> Hot | None:
        return find_hot(self.months, ["month"], self.limit)

    @cached_property
    def hot_all(self) -> Hot | None:
        """All episodes as one group `_all`, hot when their rows in RANKED_COLUMNS columns, which one task would hold, pass the row limit."""
        return find_hot(self.months.select(F.lit(0).alias("_all")), ["_all"], self.limit // RANKED_COLUMNS)

    @cached_property
    def hot_month_trades(self) -> Hot | None:
        """Periods with more trades than the row limit."""
        return find_hot(self.base.select((F.col("l_suppkey") % 12).cast("int").alias("month")), ["month"], self.limit)

    @cached_property
    def hot_all_trades(self) -> Hot | None:
        return find_hot(self.base.select(F.lit(0).alias("_all")), ["_all"], self.limit)

    @cached_property
    def clicks(self) -> Tape:
        """The second ordered stream: a user's events against the wall clock."""
        df = self.table("events").select(
            F.col("user_id").alias("sample_id"),
            (-F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"),
            "event_id",
            "event_type",
            F.col("value").alias("volume"),
        )
        return Tape.of(df, ties=("event_id",), limit=self.limit)


def _clock(seconds: float):
    return (F.lit(seconds) * F.col("d") / F.lit(366)).alias("s")


@lru_cache(maxsize=16)
def episodes(spark: SparkSession, folder: str, limit: int = DEFAULT_LIMIT) -> Episodes:
    return Episodes(spark, folder, limit)
