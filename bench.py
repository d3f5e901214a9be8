"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.operators.arrow import redact_udf
from veilspark.operators.rules import RuleSet
from veilspark.plans import queries as plans

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "redact_chain_documents", "redact_arrow_documents", "redact_builtin_documents", "findings_by_rule", "rule_hit_counts", "run_stats", "split_lines",
    "findings_cube", "json_requests", "redact_large_catalog", "findings_vs_labels", "redact_generated_arrow",
]
#: Lines of the throughput runs, one in ten with a secret; each line has about 90 bytes.
MANY = int(os.environ.get("BENCH_LINES", "5000000"))


def log_lines(spark: SparkSession, n: int, secret_every: int):
    i = F.col("id")
    clean = F.concat(F.lit("2024-01-15 10:23:45 INFO [worker-"), (i % 64).cast("string"), F.lit("] request "), i.cast("string"), F.lit(" to /v1/items finished in "), (i % 997).cast("string"), F.lit(" ms with status 200"))
    secret = F.concat(F.lit("2024-01-15 10:23:46 WARN login by user"), i.cast("string"), F.lit("@example.com password=hunter"), i.cast("string"), F.lit(" from 10.0.3.7"))
    line = F.when(i % secret_every == 0, secret).otherwise(clean) if secret_every else clean
    return spark.range(n).select(line.alias("value"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = plans.queries(), {}

    def run(name: str, df) -> None:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)

    found["redact_builtin_documents"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # workers and code are warm from here on
    for name in HEADLINE:
        run(name, found[name](spark, SF_DIR))
    rates = {}
    for label, rules, every in (("14_rules_clean", RuleSet.builtin(), 0), ("14_rules_10pct", RuleSet.builtin(), 10), ("212_rules_10pct", RuleSet.builtin().union(RuleSet.categories()), 10)):
        lines = log_lines(spark, MANY, every).cache()
        size = lines.agg(F.sum(F.octet_length("value"))).first()[0]
        run(f"lines_{label}", lines.select(redact_udf(rules, per_line=False)("value").alias("value")))
        rates[label] = {"lines_per_s": round(MANY / seconds[f"lines_{label}"]), "mb_per_s": round(size / 1e6 / seconds[f"lines_{label}"], 1)}
        lines.unpersist()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "throughput": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
