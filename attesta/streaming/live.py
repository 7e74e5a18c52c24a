"""Streaming forms: continuous dedupe and spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_urls(results: DataFrame, time_col: str = "ts", run_length: str = "1 day") -> DataFrame:
    """First result of every (run, URL); state lasts as long as a run can.

    A run's seen-set ends with the run, so ``run_length`` bounds the state
    without letting a duplicate through.
    """
    return (results.filter(F.coalesce("url", F.lit("")) != "").withWatermark(time_col, run_length)
            .dropDuplicatesWithinWatermark(["run_id", "url"]))


def spend_by_window(passes: DataFrame, width: str = "1 day", time_col: str = "ts",
                    late: str = "1 hour") -> DataFrame:
    """Passes and tokens per time window."""
    return (passes.withWatermark(time_col, late).groupBy(F.window(time_col, width))
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
            .select(F.unix_timestamp("window.start").alias("window_start"), "calls", "tokens"))


def run_to_folder(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  trigger: dict | None = None) -> None:
    """Drain what is available into a Parquet folder, exactly once.

    In ``update`` mode each trigger writes the rows that changed below its own
    ``batch=`` folder; ``latest`` reads the standing row of each key.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    query.awaitTermination()


def latest(updates: DataFrame, *key: str) -> DataFrame:
    """The last written row of each key of an ``update`` folder."""
    rest = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
