"""The batch builds over a data folder, for all periods or some.

python -m tapeframe.jobs factors   --root DATA --split train --out OUT [--months 0,1,2]
python -m tapeframe.jobs sequences --root DATA --split train --out OUT [--months 0,1,2]
python -m tapeframe.jobs layout    --root DATA [--months 0,1,2]

DATA/<split>/{market,order,transaction}.parquet, and label.parquet for train. A run replaces the periods
it computes and leaves the others. Periods are one job, not one job each. `layout` writes the events of the training split beside
them in a folder per period, {market,order,transaction}_by_month; from then on builds read these, and of them the wanted months only.
After a change of the labels it has to run anew.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import grid, sequences
from .operators.ordered import DEFAULT_LIMIT, Tape, find_hot
from .plans import cross, names
from .session import builder
from .sources import tables

CLOCK = "seconds_before_predict"
EVENTS = {"market": schema.MARKET, "order": schema.ORDER, "transaction": schema.TRADE}


class Data:
    """The tables of one split, restricted to some periods."""

    def __init__(self, spark: SparkSession, root: str, split: str, months: Sequence[int] | None = None, limit: int = DEFAULT_LIMIT, *, trusted: bool = False):
        self.spark, self.split, self.limit, self.trusted = spark, split, limit, trusted
        self.folder, self.months_wanted = f"{root}/{split}", months
        self.label = None
        if split == "train":
            label = tables.read_table(spark, f"{self.folder}/label.parquet", schema.LABEL)
            self.label = label if months is None else label.where(F.col("month").isin(list(months)))

    def _by_month(self, name: str) -> str:
        return f"{self.folder}/{name}_by_month"

    def _events(self, name: str, expected, *, laid_out: bool = True) -> DataFrame:
        if self.label is not None and laid_out:
            df = tables.read_events(self.spark, self._by_month(name), expected, self.months_wanted)
            if df is not None:
                return df.select(*expected.fieldNames(), "seq", F.col("_metadata.file_path").alias("_file"))
        df = tables.read_table(self.spark, f"{self.folder}/{name}.parquet", expected)
        df = tables.with_file_order(schema.validate_schema(df, expected), file="_file")
        return df if self.label is None else df.join(self.label.select("sample_id"), "sample_id", "left_semi")

    def tape(self, name: str, *, laid_out: bool = True) -> Tape:
        """An event table whose rows are ordered by clock and place in their file. Unless `trusted`, two jobs over keys, clocks and places
        make sure first that this is an order: every episode in one file, and there oldest rows first."""
        tape = Tape.of(self._events(name, EVENTS[name], laid_out=laid_out), clock=CLOCK, ties=("seq",), limit=self.limit)
        if not self.trusted:
            keys = tape.map(lambda df: df.select(tape.key, tape.clock, "seq", "_file"))
            sequences.check_order(sequences.check_one_file(keys, "_file"), "seq")
        return tape.map(lambda df: df.drop("_file"))

    def lay_out(self) -> None:
        """Writes every event table by month, from the original files."""
        if self.label is None:
            raise ValueError("only the training split has periods")
        for name in EVENTS:
            tape = self.tape(name, laid_out=False)
            columns = [F.col(tape.clock).alias(CLOCK) if c == CLOCK else F.col(c) for c in EVENTS[name].fieldNames()]
            tables.write_events(tape.df.select(*columns, "seq"), self._by_month(name), self.months)

    @property
    def months(self) -> DataFrame | None:
        return None if self.label is None else self.label.select("sample_id", "month")


def factor_table(data: Data, wanted: Sequence[str] = tuple(names.ALL)) -> DataFrame:
    """All factors with month and target. Large trades are measured against their period on the training
    split and against the whole table on the test split."""
    market, orders, trades = (data.tape(n) for n in ("market", "order", "transaction"))
    months = data.months
    rows = trades.df.select("sample_id")
    group = rows.select(F.lit(0).alias("_all")) if months is None else rows.join(months, "sample_id").select("month")
    hot = find_hot(group, group.columns, data.limit)
    sizes = cross.episode_thresholds(trades, months, cross.size_thresholds(trades, months, hot))
    factors = cross.catalogue(market, orders, trades, wanted, sizes=sizes)
    return factors if data.label is None else factors.join(data.label, "sample_id", "left")


def build_factors(data: Data, out: str, wanted: Sequence[str] = tuple(names.ALL)) -> None:
    df = factor_table(data, wanted)
    if data.label is None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(out)
    else:
        tables.write_periods(df, out)


def build_sequences(data: Data, out: str) -> None:
    """Snapshot sequence, scale index, flow grid with derived channels, and both event sequences."""
    market, orders, trades = (data.tape(n) for n in ("market", "order", "transaction"))
    ids = market.df.select("sample_id").distinct() if data.label is None else data.label.select("sample_id")
    index = sequences.snapshot_index(market, data.split)
    cells = grid.flow_cells(orders, trades, ids)
    scale = ids.join(index, "sample_id", "left").na.fill({"U_s": sequences.TICK_FALLBACK[data.split]})
    parts = {
        "snapshots": sequences.snapshot_sequence(market, data.split),
        "index": index,
        "flow": grid.join_channels(grid.flow_channels(cells, scale), grid.derived_channels(cells, scale)),
        "order_events": sequences.event_sequence(orders, ids, index, data.split),
        "trade_events": sequences.event_sequence(trades, ids, index, data.split),
    }
    for name, df in parts.items():
        if data.label is None:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")
        else:
            tables.write_periods(df.join(data.months, "sample_id"), f"{out}/{name}")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=["factors", "sequences", "layout"])
    p.add_argument("--root", required=True)
    p.add_argument("--split", choices=["train", "test"], default="train")
    p.add_argument("--out", help="needed by factors and sequences")
    p.add_argument("--months", help="comma-separated periods; all by default")
    p.add_argument("--trusted", action="store_true", help="don't check the order of rows first")
    a = p.parse_args()
    if a.what != "layout" and not a.out:
        p.error("--out is needed")
    spark = builder(f"tapeframe-{a.what}").getOrCreate()
    months = None if a.months is None else [int(m) for m in a.months.split(",")]
    data = Data(spark, a.root, a.split, months, trusted=a.trusted)
    if a.what == "layout":
        data.lay_out()
    else:
        (build_factors if a.what == "factors" else build_sequences)(data, a.out)


if __name__ == "__main__":
    main()
