"""Text sources and sinks, and the way between documents and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.engine import Redactor
from veilspark.operators.native import split_lines


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` per line; only ``\\n`` ends a line, blank lines and a last line without newline count, ``\\r`` stays."""
    return spark.read.option("lineSep", "\n").text(path)


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def redact_files(redactor: Redactor, source: str | list[str], target: str, mode: str = "errorifexists") -> None:
    """Lines of ``source`` redacted to text files below ``target``; no shuffle, the order inside each split is kept."""
    lines = read_lines(redactor.spark, source)
    write_lines(lines.select(redactor.redact("value").alias("value")), target, mode=mode)


def explode_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys``, line_no (from 0) and value, one row per line of ``text``; a null text has none."""
    return df.select(*keys, F.posexplode(split_lines(text)).alias("line_no", "value"))


def assemble_lines(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents of lines again, in the order of line_no; a document's lines must fit one row as they did before."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias(text))


def over_long(line: Column | str, max_bytes: int) -> Column:
    """Whether a line has more than ``max_bytes`` bytes."""
    return F.octet_length(line) > max_bytes
