"""Streams: features of volumes as they arrive, and windowed statistics of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.plans.config import Config
from voxframe.plans.run import OUT, run


def stream_features(volumes: DataFrame, configs: dict[str, Config], path: str, checkpoint: str):  # noqa: ANN201
    """Writes the long features of each micro-batch of volumes as Parquet; exactly once, by the checkpoint and batch folders."""

    def write(batch: DataFrame, number: int) -> None:
        run(batch, configs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return volumes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, at: str = "ts", by: str = "event_type", value: str = "value", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, sum and mean of a value in tumbling or sliding windows; works on streams (append mode) and tables alike."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, late) if events.isStreaming else events
    return out.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select("w.start", "w.end", by, "n", "total", "mean")


__all__ = ["OUT", "stream_features", "windowed"]
