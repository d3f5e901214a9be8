"""Reports on findings: our own relational queries over the redaction engine's results.

All of them aggregate before they shuffle; the rule catalog, a table of known size, is the only side that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.arrow import findings_udf
from veilspark.operators.native import has_match, hit_count, redact_lines_chain, split_lines
from veilspark.operators.rules import RuleSet

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def found(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """Findings of all documents with the document's language and source: no shuffle."""
    return _documents(spark, sf_dir).select("doc_id", "lang", "source", F.inline(findings_udf(rules)("text")))


def by_rule(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """Findings and documents of each rule, joined to the catalog."""
    counts = found(spark, sf_dir, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"))
    # The catalog has one row per rule: a few thousand at most.
    catalog = F.broadcast(rules.to_df(spark).select("rule_id", "name", "category"))
    return counts.join(catalog, "rule_id").select("name", "category", "n_findings", "n_docs")


def by_column(spark: SparkSession, sf_dir: str, rules: RuleSet, column: str) -> DataFrame:
    """Share of documents with findings by a column."""
    flagged = _documents(spark, sf_dir).select(column, has_match("text", rules).cast("long").alias("hit"))
    return flagged.groupBy(column).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("hit").alias("n_modified")).withColumn("pct_modified", F.round(100.0 * F.col("n_modified") / F.col("n_docs"), 4))


def without_findings(spark: SparkSession, sf_dir: str, rules: RuleSet, how: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = found(spark, sf_dir, rules).select("doc_id").distinct()
    return docs.select("doc_id").join(hits, "doc_id", how)


def by_label(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """Findings against quality and toxicity labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flagged = _documents(spark, sf_dir).select("doc_id", sum((hit_count("text", r) for r in rules), F.lit(0)).alias("hits"))
    joined = labels.join(flagged, "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("hits").cast("long").alias("n_hits"))


def top_rules(spark: SparkSession, sf_dir: str, rules: RuleSet, k: int = 3) -> DataFrame:
    """The ``k`` rules with most findings; the limit is the report."""
    counts = found(spark, sf_dir, rules).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(k)


def cube_lang_rule(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """Findings by language and rule with all subtotals."""
    return found(spark, sf_dir, rules).cube("lang", "name").agg(F.count(F.lit(1)).alias("n"))


def busiest_document(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """Of each source the document with most hits, the least id of equals: an aggregate, not a window over the source."""
    flagged = _documents(spark, sf_dir).select("source", "doc_id", sum((hit_count("text", r) for r in rules), F.lit(0)).cast("long").alias("hits"))
    best = flagged.groupBy("source").agg(F.min(F.struct((-F.col("hits")).alias("h"), "doc_id")).alias("b"))
    return best.select("source", F.col("b.doc_id").alias("doc_id"), (-F.col("b.h")).alias("n_hits"))


def redacted_lines(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """Native redaction line by line: the same result as the Arrow path where tags do not meet."""
    return _documents(spark, sf_dir).select("doc_id", redact_lines_chain("text", rules).alias("redacted"))


def lines_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("source").agg(F.sum(F.size(split_lines("text"))).alias("n_lines"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


def events_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a user's rule in event properties by hour and event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    marked = events.select("ts", "event_type", F.regexp_count("props", F.lit('"k": [5-9][0-9]')).cast("long").alias("n"))
    hours = marked.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.sum("n").alias("n_findings"))
    return hours.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n_findings")


def registered(rules: RuleSet, hits_sql: Callable[[str, RuleSet], str]) -> dict[str, tuple[Query, str | None]]:
    """Queries and SQL by name."""
    per_rule = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{r.name}' AS name, '{r.category}' AS category, {hits_sql('text', RuleSet.of([r]))} AS n FROM documents" for r in rules
    )
    total = f"({hits_sql('text', rules)})"
    columns = {
        f"pct_modified_by_{c}": (
            partial(by_column, rules=rules, column=c),
            f"SELECT {c}, count(*) AS n_docs, CAST(sum(h) AS BIGINT) AS n_modified, round(100.0 * sum(h) / count(*), 4) AS pct_modified FROM (SELECT {c}, CASE WHEN {total} > 0 THEN 1 ELSE 0 END AS h FROM documents) GROUP BY {c}",
        )
        for c in ("lang", "source")
    }
    return columns | {
        "findings_by_rule": (partial(by_rule, rules=rules), f"SELECT name, category, CAST(sum(n) AS BIGINT) AS n_findings, count(*) AS n_docs FROM ({per_rule}) WHERE n > 0 GROUP BY name, category"),
        "docs_without_findings": (partial(without_findings, rules=rules, how="left_anti"), f"SELECT doc_id FROM documents WHERE {total} = 0"),
        "docs_with_findings": (partial(without_findings, rules=rules, how="left_semi"), f"SELECT doc_id FROM documents WHERE {total} > 0"),
        "findings_vs_labels": (partial(by_label, rules=rules), f"SELECT quality, toxic, count(*) AS n_docs, CAST(sum({total}) AS BIGINT) AS n_hits FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic"),
        "top_rules": (partial(top_rules, rules=rules), f"SELECT name, CAST(sum(n) AS BIGINT) AS n FROM ({per_rule}) GROUP BY name HAVING sum(n) > 0 ORDER BY n DESC, name LIMIT 3"),
        "findings_cube": (partial(cube_lang_rule, rules=rules), f"SELECT lang, name, CAST(sum(n) AS BIGINT) AS n FROM ({per_rule}) WHERE n > 0 GROUP BY CUBE (lang, name)"),
        "busiest_document": (partial(busiest_document, rules=rules), f"SELECT source, doc_id, n_hits FROM (SELECT source, doc_id, CAST({total} AS BIGINT) AS n_hits, row_number() OVER (PARTITION BY source ORDER BY {total} DESC, doc_id) AS rk FROM documents) WHERE rk = 1"),
        "lines_per_source": (lines_per_source, "SELECT source, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY source"),
        "events_per_window": (events_per_window, """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, CAST(sum(len(regexp_extract_all(props, '"k": [5-9][0-9]'))) AS BIGINT) AS n_findings FROM events GROUP BY 1, 2"""),
    }
