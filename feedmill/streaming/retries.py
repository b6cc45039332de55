"""Bounded retries of failed stage work, and replay of dead letters [T4, P7, T1].

A stateful stream reads what the stages report and holds the failures of each (article, stage, model) since its last
success.  A failure below the limit gives an order to try again, not before a wait that doubles; the one that reaches the limit,
and every later one, gives an order to give up, which is where dead letters arise.  A replayed letter gives an order too.

Orders are a batch-stamped table.  A stage takes the orders that are due and not taken yet, does the work and notes them
as taken in a table of tries, both under one number: a run that stops in between takes the same orders under the same
number again, and its rows replace each other.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedmill import fixed_values as fv
from feedmill.operators.dedup import absent_keys
from feedmill.operators.state import replay_plan
from feedmill.session import staged
from feedmill.streaming.batches import read_batches, write_batch
from feedmill.streaming.snapshots import Folder
from feedmill.streaming.tables import file_stream, run_available

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETRY, GIVE_UP, REPLAY = "retry", "give up", "replay"

_KEY = [T.StructField("article_id", T.LongType()), T.StructField("stage", T.StringType()), T.StructField("model", T.StringType())]
REPORTS = T.StructType([*_KEY, T.StructField("outcome", T.StringType()), T.StructField("ts", T.TimestampNTZType())])
ORDERS = T.StructType(
    [*_KEY, T.StructField("attempts", T.LongType()), T.StructField("action", T.StringType()), T.StructField("not_before", T.TimestampNTZType())]
)
REPLAYS = T.StructType([T.StructField("letter_id", T.LongType()), *REPORTS.fields])


@dataclass(frozen=True)
class RetryRule:
    """How often a piece of work may fail, which stages try again by themselves, and the waits in seconds between tries.

    Extraction does not: a landed page stays as it is, so only a replay extracts it again.
    """

    max_retries: int = fv.MAX_RETRIES
    stages: tuple[str, ...] = ("summarization", "embedding")
    first_wait: float = 0.0
    longest_wait: float = 3600.0

    def wait(self, attempts: int) -> datetime.timedelta:
        return datetime.timedelta(seconds=min(self.longest_wait, self.first_wait * 2.0 ** (attempts - 1)))


class RetryLedger(StatefulProcessor):
    """Failures since the last success of one (article, stage, model); successes clear the state, so it holds failed work only."""

    def __init__(self, rule: RetryRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count = self.failures.get()[0] if self.failures.exists() else 0
        orders = []
        reports = sorted((ts, outcome) for part in rows for ts, outcome in zip(part["ts"], part["outcome"]))
        for ts, outcome in reports:
            if outcome == "failed":
                count += 1
                more = count < self.rule.max_retries
                if key[1] in self.rule.stages:
                    orders.append((*key, count, RETRY if more else GIVE_UP, ts + self.rule.wait(count) if more else ts))
            elif outcome == REPLAY:
                orders.append((*key, count, REPLAY, ts))
            else:
                count = 0
        if count:
            self.failures.update((count,))
        else:
            self.failures.clear()
        yield pd.DataFrame(orders, columns=ORDERS.names)

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class RetryBook:
    """Where the tables of orders, tries and replays live, beside the outcomes of the stages."""

    root: str
    rule: RetryRule = RetryRule()

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def update(self, spark: SparkSession) -> None:
        """Turn new outcomes and replays into orders."""
        if not Folder(spark, self.table("outcomes")).names():
            return
        if not Folder(spark, self.table("replays")).names():
            write_batch(spark.createDataFrame([], REPLAYS), self.table("replays"), 0)  # a stream needs its folder
        reports = file_stream(spark, self.table("outcomes"), REPORTS).unionByName(file_stream(spark, self.table("replays"), REPORTS))
        # Work that never failed has no state and gives no orders.
        orders = reports.groupBy(*[f.name for f in _KEY]).transformWithStateInPandas(
            statefulProcessor=RetryLedger(self.rule), outputStructType=ORDERS, outputMode="Append", timeMode="None"
        )
        setting = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(setting, None)
        spark.conf.set(setting, ROCKSDB)
        try:
            run_available(orders, lambda rows, batch: write_batch(rows, self.table("orders"), batch), f"{self.root}/checkpoints/orders")
        finally:
            spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)

    def orders(self, spark: SparkSession) -> DataFrame:
        return read_batches(spark, self.table("orders"), ORDERS)

    def due(self, spark: SparkSession, stage: str, at: datetime.datetime, model: str | None = None) -> DataFrame:
        """The orders of a stage (and model) whose time has come and that no try has taken; the tables hold failures only."""
        open_orders = self.orders(spark).filter((F.col("stage") == stage) & (F.col("action") != GIVE_UP))
        if model is not None:
            open_orders = open_orders.filter(F.coalesce("model", F.lit(model)) == model)
        taken = read_batches(spark, self.table("tries"), ORDERS).withColumnRenamed("batch_id", "_try")
        same = F.lit(True)
        for name in ORDERS.names:
            same = same & open_orders[name].eqNullSafe(taken[name])
        found = open_orders.filter(F.col("not_before") <= F.lit(at).cast("timestamp_ntz"))
        return found.join(taken, same, "left_anti").select(*ORDERS.names)

    def next_try(self, spark: SparkSession) -> int:
        """The number of the next try; the same again for one that stopped before it was noted."""
        last = read_batches(spark, self.table("tries"), ORDERS).agg(F.max("batch_id")).first()[0]
        return 1 if last is None else last + 1

    def note(self, orders: DataFrame, number: int) -> None:
        """The orders of a try are done with, whatever came of them; outcomes say that."""
        write_batch(orders.select(*ORDERS.names), self.table("tries"), number)

    def replay(self, letters: DataFrame, at: datetime.datetime) -> DataFrame:
        """Route dead letters back to their stages, each letter once; returns the plan of the letters given [T4]."""
        spark = letters.sparkSession
        plan = staged(replay_plan(letters), "replays")
        earlier = read_batches(spark, self.table("replays"), REPLAYS)
        routed = plan.filter("skip_reason IS NULL").dropDuplicates(["id"]).select(
            F.col("id").alias("letter_id"), "article_id", F.col("target_queue").alias("stage"), "model",
            F.lit(REPLAY).alias("outcome"), F.lit(at).cast("timestamp_ntz").alias("ts"),
        )
        number = (earlier.agg(F.max("batch_id")).first()[0] or 0) + 1
        write_batch(absent_keys(routed, earlier, "letter_id").select(*REPLAYS.names), self.table("replays"), number)
        return plan
