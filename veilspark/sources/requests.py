"""Request and response bodies in JSON, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.engine import Redactor
from veilspark.operators.native import split_lines, tag_count

REQUEST, BATCH_REQUEST = "text string", "texts array<string>"


def _lines(text: Column) -> Column:
    return F.coalesce(F.size(split_lines(text)), F.lit(0))


def _modified(before: Column, after: Column) -> Column:
    pairs = F.arrays_zip(split_lines(before).alias("a"), split_lines(after).alias("b"))
    return F.size(F.filter(pairs, lambda p: ~p["a"].eqNullSafe(p["b"])))


def redact_requests(redactor: Redactor, df: DataFrame, body: str, response: str = "response") -> DataFrame:
    """``{"text"}`` bodies to ``{"redacted", "stats"}``; a body that is no such JSON gives null."""
    text = F.from_json(F.col(body), REQUEST)["text"]
    marked = df.withColumn("__text", text).withColumn("__red", redactor.redact_text("__text"))
    stats = F.struct(
        _lines(F.col("__text")).alias("lines_processed"), _modified(F.col("__text"), F.col("__red")).alias("lines_modified"),
        tag_count("__red").cast("int").alias("patterns_matched"),
    )
    answer = F.when(F.col("__text").isNotNull(), F.to_json(F.struct(F.col("__red").alias("redacted"), stats.alias("stats"))))
    return marked.withColumn(response, answer).drop("__text", "__red")


def redact_batch_requests(redactor: Redactor, df: DataFrame, body: str, response: str = "response") -> DataFrame:
    """``{"texts"}`` bodies to ``{"results", "stats"}``, results in the order of the texts."""
    marked = df.withColumn("__texts", F.from_json(F.col(body), BATCH_REQUEST)["texts"]).withColumn("__red", redactor.redact_array("__texts"))
    pairs = F.arrays_zip(F.col("__texts").alias("a"), F.col("__red").alias("b"))
    results = F.transform(pairs, lambda p: F.struct(
        p["b"].alias("redacted"), _lines(p["a"]).alias("lines_processed"), _modified(p["a"], p["b"]).alias("lines_modified"), tag_count(p["b"]).cast("int").alias("patterns_matched"),
    ))
    marked = marked.withColumn("__results", results)

    def total(name: str) -> Column:
        return F.aggregate("__results", F.lit(0), lambda a, x: a + F.coalesce(x[name], F.lit(0)))

    stats = F.struct(
        F.size("__results").alias("items_processed"), total("lines_processed").alias("total_lines"),
        total("lines_modified").alias("total_modified"), total("patterns_matched").alias("total_patterns_matched"),
    )
    answer = F.when(F.col("__texts").isNotNull(), F.to_json(F.struct(F.col("__results").alias("results"), stats.alias("stats"))))
    return marked.withColumn(response, answer).drop("__texts", "__red", "__results")


def redact_events(redactor: Redactor, df: DataFrame, body: str, schema: str, fields: list[str]) -> DataFrame:
    """JSON objects of a schema with the named string fields redacted; keys outside the schema are dropped.

    A body that is no such JSON, or does not fit the schema, is redacted as plain text: nothing passes unseen.
    """
    event = F.from_json(F.col(body), f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    marked = df.withColumn("__event", event)
    marked = marked.withColumns({f"__field{i}": redactor.redact_text(F.col(f"__event.{x}")) for i, x in enumerate(fields)})
    marked = marked.withColumn("__plain", redactor.redact_text(F.when(F.col("__event").isNull() | F.col("__event.__corrupt").isNotNull(), F.col(body))))
    done = F.col("__event")
    for i, x in enumerate(fields):
        done = done.withField(x, F.col(f"__field{i}"))
    names = [f"__field{i}" for i in range(len(fields))]
    return marked.withColumn(body, F.coalesce("__plain", F.to_json(done.dropFields("__corrupt")))).drop("__event", "__plain", *names)
