"""The same transforms on streams: a stateless map in append mode, and windowed counts of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.engine import Redactor
from veilspark.sources.requests import redact_events


def redact_stream(redactor: Redactor, source: str, target: str, checkpoint: str, available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Lines of files that arrive below ``source`` redacted to text files below ``target``, exactly once by the checkpoint."""
    lines = redactor.spark.readStream.option("lineSep", "\n").text(source)
    writer = lines.select(redactor.redact("value").alias("value")).writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime=interval).start()


def redact_table_stream(redactor: Redactor, stream: DataFrame, columns: list[str]) -> DataFrame:
    """A streaming table with text columns redacted; the same plan as in batch."""
    return redactor.transform(stream, columns)


def findings_per_window(redactor: Redactor, stream: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by rule and event-time window; rows later than ``late`` behind the watermark are dropped by Spark."""
    found = stream.withWatermark(time, late).select(time, F.inline(redactor.findings(text)))
    return found.groupBy(F.window(time, window), "name").agg(F.count(F.lit(1)).alias("n"))


def ship_events(redactor: Redactor, stream: DataFrame, body: str, schema: str, fields: list[str], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """JSON log events, the named fields redacted, to text files of JSON below ``target``, a folder for each micro-batch.

    A batch that is run again after a failure overwrites its own folder, so every event arrives once.
    """

    def write(batch: DataFrame, number: int) -> None:
        redact_events(redactor, batch, body, schema, fields).select(body).write.mode("overwrite").text(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="10 seconds").start()
