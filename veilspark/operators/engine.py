"""The facade: a rule set bound to a policy, as column functions, table transforms and statistics."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators import arrow, native
from veilspark.operators.arrow import Policy, compiled
from veilspark.operators.rules import RuleSet

VERSION = "1.0.0"
#: Rule sets of at most so many rules may run as native chains.
NATIVE_RULES = 16


@dataclass(frozen=True)
class RedactConfig:
    """What to load and how to run it."""

    pattern_file: str | None = None
    pattern_dir: str | None = None
    compliance: tuple[str, ...] = ()
    #: None: the built-in rules are added only when nothing else is loaded.
    include_defaults: bool | None = None
    mode: str = "complete"
    on_error: str = "raise"
    max_line_bytes: int | None = None
    long_lines: str = "process"

    def rules(self) -> RuleSet:
        out = RuleSet()
        if self.pattern_file:
            out = out.union(RuleSet.from_file(self.pattern_file))
        if self.pattern_dir:
            out = out.union(RuleSet.from_dir(self.pattern_dir))
        if self.compliance:
            out = out.union(RuleSet.profiles(*self.compliance))
        if self.include_defaults or self.include_defaults is None and not len(out):
            out = RuleSet.builtin().union(out)
        return out

    def policy(self) -> Policy:
        return Policy(self.mode, self.on_error, self.max_line_bytes, self.long_lines)


@dataclass
class Stats:
    """Counters of one run."""

    lines_processed: int = 0
    lines_modified: int = 0
    patterns_matched: int = 0
    spans: int = 0
    bytes_read: int = 0
    bytes_written: int = 0
    patterns_loaded: int = 0
    elapsed_seconds: float = 0.0

    @property
    def lines_per_second(self) -> float:
        return self.lines_processed / self.elapsed_seconds if self.elapsed_seconds else 0.0

    @property
    def mb_per_second(self) -> float:
        return self.bytes_read / 1e6 / self.elapsed_seconds if self.elapsed_seconds else 0.0

    @property
    def modified_percent(self) -> float:
        return 100.0 * self.lines_modified / self.lines_processed if self.lines_processed else 0.0


@dataclass
class Redactor:
    """Column functions and transforms of one rule set. Nothing is collected; all results are Spark expressions."""

    spark: SparkSession | None = None
    rules: RuleSet = field(default_factory=RuleSet.builtin)
    policy: Policy = field(default_factory=Policy)
    started: float = field(default_factory=time.monotonic, init=False)
    totals: Stats = field(default_factory=Stats, init=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, init=False, repr=False)

    @staticmethod
    def from_config(spark: SparkSession | None, config: RedactConfig) -> Redactor:
        return Redactor(spark, config.rules(), config.policy())

    # Column functions.

    def redact(self, text: Column | str) -> Column:
        """A value as one line."""
        return arrow.redact_udf(self.rules, self.policy, per_line=False)(text)

    def redact_text(self, text: Column | str) -> Column:
        """A value line by line, newlines kept."""
        return arrow.redact_udf(self.rules, self.policy)(text)

    def redact_array(self, texts: Column | str) -> Column:
        return arrow.redact_lists_udf(self.rules, self.policy)(texts)

    def findings(self, text: Column | str) -> Column:
        return arrow.findings_udf(self.rules, self.policy)(text)

    def result(self, text: Column | str) -> Column:
        return arrow.result_udf(self.rules, self.policy)(text)

    def has_sensitive(self, text: Column | str) -> Column:
        return arrow.sensitive_udf(self.rules, self.policy)(text)

    def redact_native(self, text: Column | str) -> Column:
        """The Catalyst chain; for small rule sets."""
        if len(self.rules) > NATIVE_RULES:
            raise ValueError(f"{len(self.rules)} rules; a chain takes at most {NATIVE_RULES}")
        return native.redact_chain(text, self.rules)

    @staticmethod
    def tag_count(text: Column | str) -> Column:
        return native.tag_count(text)

    @staticmethod
    def modified(before: Column, after: Column) -> Column:
        return ~before.eqNullSafe(after)

    # Tables.

    def transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with the named text columns redacted; all others pass through."""
        return df.withColumns({c: self.redact_text(c) for c in columns})

    def findings_table(self, df: DataFrame, text: str, keys: list[str]) -> DataFrame:
        """One row per finding: ``keys``, line_no, rule_id, name, start, end, match."""
        return df.select(*keys, F.inline(self.findings(text))).select(*keys, "line_no", "rule_id", "name", "start", "end", "match")

    def stats(self, df: DataFrame, text: str) -> DataFrame:
        """One row: lines, modified lines, hits, spans, bytes in and out of ``text``, taken line by line."""
        lines = df.select(F.explode(native.split_lines(text)).alias("line")).select("line", arrow.result_udf(self.rules, self.policy, False)("line").alias("r"))
        return lines.agg(
            F.count(F.lit(1)).alias("lines_processed"), F.coalesce(F.sum(F.col("r.modified").cast("long")), F.lit(0)).alias("lines_modified"),
            F.coalesce(F.sum("r.n_hits"), F.lit(0)).alias("patterns_matched"), F.coalesce(F.sum("r.n_spans"), F.lit(0)).alias("spans"),
            F.coalesce(F.sum(F.octet_length("line")).cast("long"), F.lit(0)).alias("bytes_read"),
            F.coalesce(F.sum(F.octet_length("r.redacted")).cast("long"), F.lit(0)).alias("bytes_written"), F.lit(len(self.rules)).cast("long").alias("patterns_loaded"),
        )

    def observed(self, df: DataFrame, text: str) -> tuple[DataFrame, Observation]:
        """``df`` with ``text`` redacted, and counters that are ready once an action has run."""
        seen = Observation()
        marked = df.withColumn("__r", self.result(text))
        watched = marked.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.sum(F.col("__r.modified").cast("long")).alias("rows_modified"),
            F.sum("__r.n_hits").alias("patterns_matched"), F.sum(F.octet_length(text)).alias("bytes_read"), F.sum(F.octet_length("__r.redacted")).alias("bytes_written"),
        )
        return watched.withColumn(text, F.col("__r.redacted")).drop("__r"), seen

    def stream(self, source: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Lines of files that arrive below ``source``, redacted to text files below ``target``."""
        from veilspark.streaming.streams import redact_stream

        return redact_stream(self, source, target, checkpoint, available_now)

    # Values on the driver.

    def redact_value(self, text: str | None) -> str | None:
        """One value, without Spark."""
        return self.redact_values([text])[0]

    def redact_values(self, texts: list[str | None]) -> list[str | None]:
        began = time.monotonic()
        results = compiled(self.rules, self.policy, True).results(pa.array(texts, pa.string())).to_pylist()
        with self._lock:
            t = self.totals
            for text, r in zip(texts, results, strict=True):
                if text is None or r is None:
                    continue
                t.lines_processed += text.count("\n") + 1
                t.lines_modified += len({f["line_no"] for f in r["findings"]})
                t.patterns_matched += r["n_hits"]
                t.spans += r["n_spans"]
                t.bytes_read += len(text.encode("utf-8", "replace"))
                t.bytes_written += len((r["redacted"] or "").encode("utf-8", "replace"))
            t.patterns_loaded = len(self.rules)
            t.elapsed_seconds += time.monotonic() - began
        return [None if r is None else r["redacted"] for r in results]

    def redact_lines(self, lines: list[str]) -> list[str]:
        """Many lines at once, in order."""
        return self.redact_values(lines)

    def redact_buffer(self, text: str) -> str:
        """Newline-divided text; a newline at its end stays."""
        return self.redact_value(text) or ""

    @staticmethod
    def version() -> str:
        return VERSION

    @staticmethod
    def is_threadsafe() -> bool:
        """Rules are immutable and counters are locked."""
        return True

    def reset_stats(self) -> None:
        with self._lock:
            self.totals = Stats()

    def pattern_count(self) -> int:
        return len(self.rules)

    def health(self) -> dict[str, object]:
        up = time.monotonic() - self.started
        return {
            "status": "healthy", "version": VERSION, "uptime_seconds": up, "patterns_loaded": len(self.rules),
            "lines_processed": self.totals.lines_processed, "patterns_matched": self.totals.patterns_matched,
            "avg_lps": self.totals.lines_processed / up if up else 0.0,
        }

    def register_sql(self, prefix: str = "veil_") -> list[str]:
        """Make the functions available to SQL: redact, redact_text, findings, has_sensitive and the table function findings_of."""
        from veilspark.functions.sql import register

        return register(self, prefix)
