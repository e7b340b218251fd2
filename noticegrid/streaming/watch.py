"""Page-change detection over streams: one remembered hash per source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from noticegrid.operators.ordered import page_changes

OUTPUT = "source_id bigint, event_id bigint, kind string"
STATE = "source_id bigint, observed_at timestamp_ntz, event_id bigint, text_hash bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def detect_changes(observations: DataFrame, output: str, state: str, checkpoint: str) -> None:
    """Classify arriving observations against the last one of their source, then stop.

    Each micro-batch is a batch job: the last row per source of the batch before joins the new rows
    at the head of its source, so a source with very many observations takes the split path of the
    batch operator. Output and state are written per batch number; a repeated batch replaces its own.
    """
    spark = observations.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = (
            spark.read.schema(STATE).parquet(f"{state}/{number - 1}") if number else spark.createDataFrame([], STATE))
        rows = batch.select(*before.columns, F.lit(1).alias("turn")).unionByName(before.withColumn("turn", F.lit(0)))
        kinds = page_changes(rows, order=["turn", "observed_at", "event_id"]).filter("turn = 1")
        kinds.select("source_id", "event_id", "kind").write.mode("overwrite").parquet(f"{output}/batch={number}")
        last = rows.groupBy("source_id").agg(F.max_by(
            F.struct("observed_at", "event_id", "text_hash"), F.struct("turn", "observed_at", "event_id")).alias("s"))
        last.select("source_id", "s.*").write.mode("overwrite").parquet(f"{state}/{number}")

    query = (
        observations.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()


class LastHash(StatefulProcessor):
    """Keyed-state form for feeds that deliver each source in order, such as one file per watch run.

    Rows stream through in Arrow chunks and only the last one is remembered. Input that runs
    backwards in time stops the query instead of giving a wrong answer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([
            StructField("text_hash", LongType()), StructField("observed_at", TimestampType())]))

    def handleInputRows(self, key, rows, timer_values):
        previous, at = self.last.get() if self.last.exists() else (None, None)
        for pdf in rows:
            pdf = pdf.sort_values(["observed_at", "event_id"])
            if at is not None and pdf["observed_at"].iloc[0] < pd.Timestamp(at):
                raise ValueError("Observations of a source arrived out of order")
            before = pdf["text_hash"].shift(1).astype("object")
            before.iloc[0] = previous
            kind = [
                "source_discovered" if b is None else "same" if b == h else "source_changed"
                for b, h in zip(before, pdf["text_hash"])]
            previous, at = int(pdf["text_hash"].iloc[-1]), pdf["observed_at"].iloc[-1].to_pydatetime()
            yield pd.DataFrame({"source_id": pdf["source_id"], "event_id": pdf["event_id"], "kind": kind})
        if previous is not None:
            self.last.update((previous, at))

    def close(self) -> None:
        pass


def watch_changes(observations: DataFrame) -> DataFrame:
    """Stream of (source_id, event_id, kind). Needs the RocksDB state store provider."""
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return observations.groupBy("source_id").transformWithStateInPandas(
        LastHash(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
