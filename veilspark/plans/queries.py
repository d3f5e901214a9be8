"""Registered queries of the redaction engine, each with the DuckDB SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.dialect import java_replacement, sql_string, to_java, to_re2
from veilspark.functions.examples import examples
from veilspark.operators import native
from veilspark.operators.arrow import Policy, findings_udf, redact_udf, result_udf
from veilspark.operators.engine import Redactor
from veilspark.operators.native import pattern, redact_chain, split_lines
from veilspark.operators.rules import Rule, RuleSet
from veilspark.plans import reports
from veilspark.sources import lines as line_source
from veilspark.sources import requests

Query = Callable[[SparkSession, str], DataFrame]

BUILTIN = RuleSet.builtin()
BY_NAME = {r.name: r for r in BUILTIN}
EVERY_RULE = BUILTIN.union(RuleSet.profiles("all")).union(RuleSet.categories())
#: The rules that the tables have matches for.
FOUR = RuleSet.of(BY_NAME[n] for n in ("email", "ipv4", "ssn", "credit_card"))
#: Rules whose matches overlap.
OVERLAPPING = RuleSet.of([BY_NAME["ipv4"], Rule("at_host", "@", r"[a-z0-9]+@[0-9.]+", "")])
#: A user's own rule over JSON properties.
PROPS = RuleSet.from_lines([r'k_value|"k"|"k": [0-9]+|"k": "[REDACTED:k]"'], "inline")
#: Lines of the generated table: templates with a known secret each, chosen by number.
TEMPLATES = (
    "INFO request served in 12 ms by worker",
    "DEBUG cache miss for item without secrets",
    "user mail user{n}@example.com logged in",
    "peer 10.0.{m}.7 closed the connection",
    "card 4111-1111-1111-{p} declined",
    "ssn 123-45-{p} on file",
    "using AKIAIOSFODNN7EXA{p} for upload",
    "password=hunter{n}x accepted",
    "api_key: abcdefghijklmnop{p}qrst",
    "secret = s3cr3tvalue{n}",
    "auth eyJhbGciOi{n}.eyJzdWIi{n}.c2ln{n} sent",
    "bot xoxb-{p}-abcdefghij posted",
    "-----BEGIN RSA PRIVATE KEY-----",
    "push with ghp_abcdefghijklmnopqrstuvwxyzABCDEF{p}",
    "oauth gho_abcdefghijklmnopqrstuvwxyzABCDEF{p} granted",
    "aws_secret_access_key = abcdefghij/klmnopqrst+uvwxyzABCDEFGH{p} set",
)
LINES = 20_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generated_lines(spark: SparkSession, n: int = LINES) -> DataFrame:
    """``line_no, value``: templates in turn, with numbers put in."""
    i = F.col("id")
    text: Column = F.element_at(F.array(*map(F.lit, TEMPLATES)), (i % len(TEMPLATES) + 1).cast("int"))
    for key, value in (("{n}", i.cast("string")), ("{m}", (i % 256).cast("string")), ("{p}", F.lpad((i % 10_000).cast("string"), 4, "0"))):
        text = F.replace(text, F.lit(key), value)
    return spark.range(n).select(i.alias("line_no"), text.alias("value"))


_GENERATED_SQL = (
    f"(SELECT id AS line_no, replace(replace(replace(list_extract([{', '.join(map(sql_string, TEMPLATES))}], CAST(id % {len(TEMPLATES)} + 1 AS INTEGER)), "
    f"'{{n}}', CAST(id AS VARCHAR)), '{{m}}', CAST(id % 256 AS VARCHAR)), '{{p}}', lpad(CAST(id % 10000 AS VARCHAR), 4, '0')) AS value FROM range({LINES}) t(id))"
)


# SQL of rules.


def pattern_sql(rule: Rule, text: str) -> str:
    own = sql_string(to_re2(rule.regex))
    return own if native._implied(rule) else f"CASE WHEN contains({text}, {sql_string(rule.literal)}) THEN {own} ELSE '[^\\s\\S]' END"


def chain_sql(text: str, rules: RuleSet) -> str:
    out = text
    for r in rules:
        out = f"regexp_replace({out}, {pattern_sql(r, text)}, {sql_string(r.tag)}, 'g')"
    return out


def hits_sql(text: str, rules: RuleSet) -> str:
    return " + ".join(f"coalesce(len(regexp_extract_all({text}, {pattern_sql(r, text)})), 0)" for r in rules)


def spans_sql(rules: RuleSet) -> str:
    """Places of the matches of rules that do not overlap: what stands between and before them, summed."""
    parts = []
    for i, r in enumerate(rules):
        p = pattern_sql(r, "value")
        starts = "[list_sum([length(x) FOR x IN g[1:k]]) + coalesce(list_sum([length(x) FOR x IN m[1:k-1]]), 0) FOR k IN range(1, len(m) + 1)]"
        parts.append(f"SELECT doc_id, line_no, CAST({i} AS BIGINT) AS rule_id, {sql_string(r.name)} AS name, unnest(m) AS match, CAST(unnest({starts}) AS BIGINT) AS start FROM (SELECT doc_id, line_no, regexp_extract_all(value, {p}) AS m, string_split_regex(value, {p}) AS g FROM {_LINES_SQL}) WHERE len(m) > 0")
    return f"SELECT doc_id, line_no, rule_id, start, CAST(start + length(match) AS BIGINT) AS \"end\", name, match FROM ({' UNION ALL '.join(parts)})"


_LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"


# Chains over whole values.


def redact_table(spark: SparkSession, sf_dir: str, table: str, keys: tuple[str, ...], text: str, rules: RuleSet) -> DataFrame:
    return _table(spark, sf_dir, table).select(*keys, redact_chain(text, rules).alias("redacted"))


def redact_changed(spark: SparkSession, sf_dir: str, rule: Rule) -> DataFrame:
    """Generated lines that one rule changes, and their redacted form."""
    lines = generated_lines(spark).where(F.regexp_like("value", pattern(rule, F.col("value"))))
    return lines.select("line_no", redact_chain("value", [rule]).alias("redacted"))


def has_sensitive_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", native.has_match("text", FOUR).alias("has_sensitive"))


def lines_with_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_source.explode_lines(_table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))), "text", ["doc_id"]).where(F.contains("value", F.lit("@"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")


def literal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RuleSet.of(r for r in BUILTIN if r.literal and r.literal != ".")
    return _table(spark, sf_dir, "documents").where(native.any_literal("text", rules)).select("doc_id")


def rule_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every built-in rule over all documents: one pass, one row of sums, then a row per rule."""
    sums = _table(spark, sf_dir, "documents").agg(*(F.coalesce(F.sum(native.hit_count("text", r)), F.lit(0)).alias(r.name) for r in BUILTIN))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(r.name).alias("name"), F.col(r.name).alias("n_hits")) for r in BUILTIN))).alias("x")).select("x.*")


def doc_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = sum((native.hit_count("text", r) for r in FOUR), F.lit(0).cast("long"))
    return _table(spark, sf_dir, "documents").select("doc_id", total.alias("n_hits"))


def findings_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    return found.select("doc_id", F.explode(native.matches("text", BY_NAME["email"])).alias("match"))


def first_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.locate("@", "text").cast("long").alias("first_at"))


def first_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the first match of a rule, from 1."""
    return _table(spark, sf_dir, "documents").select("doc_id", native.first_match("text", BY_NAME["email"]).alias("first_email"))


def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the rule that their id stands for; the catalog has one row per rule, so it is broadcast."""
    found = _table(spark, sf_dir, "documents").select("doc_id", F.inline(findings_udf(FOUR)("text")))
    rules = F.broadcast(FOUR.to_df(spark).select("rule_id", F.col("replacement").alias("tag"), "category"))
    return found.select("doc_id", "rule_id").join(rules, "rule_id").groupBy("doc_id", "tag", "category").agg(F.count(F.lit(1)).alias("n"))


def most_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first 64 matched strings of a document, as its SQL has it; ``all_hits`` has all of them."""
    found = F.slice(native.matches("text", BY_NAME["ipv4"]), 1, 64)
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("matches"), F.size(found).cast("long").alias("n"))


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matched strings of a document."""
    found = native.matches("text", BY_NAME["ipv4"])
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, " ").alias("matches"), F.size(found).cast("long").alias("n"))


# Lines.


def split_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_source.explode_lines(_table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")


def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = split_lines("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, lambda x: x == "")).cast("long").alias("n_blank"))


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(split_lines("text"), lambda x: F.octet_length(x))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(sizes).cast("long").alias("n_lines"), F.octet_length("text").cast("long").alias("n_bytes"), F.array_max(sizes).cast("long").alias("max_line_bytes"))


def over_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_source.explode_lines(_table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return lines.where(line_source.over_long("value", 2048)).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to lines and back; a null text, which has no lines, is null again."""
    docs = _table(spark, sf_dir, "documents")
    back = line_source.assemble_lines(line_source.explode_lines(docs, "text", ["doc_id"]), ["doc_id"])
    return back.union(docs.where(F.col("text").isNull()).select("doc_id", "text"))


# The Arrow path.


def redact_arrow(spark: SparkSession, sf_dir: str, rules: RuleSet) -> DataFrame:
    """All rules on every line of every document, overlaps merged."""
    return _table(spark, sf_dir, "documents").select("doc_id", redact_udf(rules)("text").alias("redacted"))


def redact_generated(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    lines = generated_lines(spark)
    if path == "native":
        return lines.select("line_no", redact_chain("value", BUILTIN).alias("redacted"))
    return lines.select("line_no", redact_udf(BUILTIN, per_line=False)("value").alias("redacted"))


def redact_large_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-ins with every category of the vendor catalog. The lines hold secrets of the built-ins alone, whose SQL says the
    same: that the catalog changes nothing else. ``rule_examples`` has a hit and a near miss of every rule."""
    rules = BUILTIN.union(RuleSet.categories())
    return generated_lines(spark).select("line_no", redact_udf(rules, per_line=False)("value").alias("redacted"))


def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every rule of the built-ins, the profiles and the catalog a line that it hits and a near miss, redacted by that rule."""
    by_name = {r.name: r for r in EVERY_RULE}
    rows = [(name, kind, line, by_name[name].literal, to_java(by_name[name].regex), java_replacement(by_name[name].tag)) for name, kind, line in examples(EVERY_RULE)]
    lines = spark.createDataFrame(rows, "rule string, kind string, value string, literal string, regex string, tag string")
    redacted = F.when(F.contains("value", F.col("literal")), F.regexp_replace("value", F.col("regex"), F.col("tag"))).otherwise(F.col("value"))
    return lines.select("rule", "kind", redacted.alias("redacted"))


def _examples_sql() -> str:
    by_name = {r.name: r for r in EVERY_RULE}
    rows = ", ".join("(" + ", ".join(map(sql_string, (name, kind, line, by_name[name].literal, to_re2(by_name[name].regex), by_name[name].tag))) + ")" for name, kind, line in examples(EVERY_RULE))
    return f"SELECT rule, kind, CASE WHEN contains(value, literal) THEN regexp_replace(value, regex, tag, 'g') ELSE value END AS redacted FROM (VALUES {rows}) t(rule, kind, value, literal, regex, tag)"


def redact_counted(spark: SparkSession, sf_dir: str, rules: RuleSet, policy: Policy = Policy()) -> DataFrame:
    """A rule set on every line of every document, with its counts."""
    return _table(spark, sf_dir, "documents").select("doc_id", result_udf(rules, policy)("text").alias("r")).select("doc_id", "r.redacted", F.col("r.n_spans").cast("long").alias("n_spans"), F.col("r.n_hits").cast("long").alias("n_hits"))


def modified_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _table(spark, sf_dir, "documents").withColumn("r", redact_udf(FOUR)("text"))
    return done.select("doc_id", Redactor.modified(F.col("text"), F.col("r")).alias("modified"))


def findings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Redactor(spark, FOUR).findings_table(_table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.select("doc_id", *(F.col(x).cast("long").alias(x) for x in ("line_no", "rule_id", "start", "end")), "name", "match")


def findings_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Arrow path finds of one rule, as strings: the same as the built-in extraction."""
    email = RuleSet.of([BY_NAME["email"]])
    return Redactor(spark, email).findings_table(_table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "match")


def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rules: an address whose host is an IPv4 address becomes one span."""
    text = F.concat(F.lit("to user"), F.col("line_no").cast("string"), F.lit("@10.0.0."), (F.col("line_no") % 200).cast("string"), F.lit(" from 10.1.1.1"))
    return generated_lines(spark, 2000).select("line_no", result_udf(OVERLAPPING, per_line=False)(text).alias("r")).select("line_no", "r.redacted", F.col("r.n_spans").cast("long").alias("n_spans"), F.col("r.n_hits").cast("long").alias("n_hits"))


def redact_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated_lines(spark).select("line_no", redact_udf(BUILTIN, Policy(mode="cascade"), per_line=False)("value").alias("redacted"))


def redact_profile(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """A made-up record per profile and number, redacted by its rules."""
    records = {"hipaa": "visit patient_id=P{n} MRN: A1B2C3{p} seen", "pci": "swipe card_number=41111111111{p} cvc: 123 ok", "gdpr": "consent_id: c-{n} VAT DE12345{p} end", "soc2": "call request_id=r-{n} done"}
    text = F.lit(records[profile])
    for key, value in (("{n}", F.col("line_no").cast("string")), ("{p}", F.lpad((F.col("line_no") % 10_000).cast("string"), 4, "0"))):
        text = F.replace(text, F.lit(key), value)
    return generated_lines(spark, 1000).select("line_no", redact_udf(RuleSet.profiles(profile), per_line=False)(text).alias("redacted"))


_PROFILE_SQL = {
    "hipaa": "'visit [REDACTED:patient_id] [REDACTED:mrn] seen'", "pci": "'swipe [REDACTED:pan] [REDACTED:cvv] ok'",
    "gdpr": "'[REDACTED:consent] VAT [REDACTED:vat] end'", "soc2": "'call [REDACTED:request_id] done'",
}


# Statistics and reports.


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Redactor(spark, FOUR).stats(_table(spark, sf_dir, "documents"), "text")


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _table(spark, sf_dir, "documents").select("doc_id", redact_chain("text", FOUR).alias("r"))
    return done.select("doc_id", native.tag_count("r").alias("n_tags"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rule over JSON text; the result is JSON still."""
    done = _table(spark, sf_dir, "events").select("event_id", redact_chain("props", PROPS).alias("props"))
    return done.select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))


def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a request body, answered."""
    bodies = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("text")).alias("body"))
    answered = requests.redact_requests(Redactor(spark, FOUR), bodies, "body")
    kind = "redacted string, stats struct<lines_processed int, lines_modified int, patterns_matched int>"
    r = F.from_json("response", kind)
    return answered.select("conv_id", "turn", r["redacted"].alias("redacted"), r["stats"]["lines_processed"].cast("long").alias("n_lines"), r["stats"]["patterns_matched"].cast("long").alias("n_tags"))


def json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one batch request: its texts in order of turns, answered in the same order."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    bodies = turns.select("conv_id", F.to_json(F.struct(F.col("t.text").alias("texts"))).alias("body"))
    answered = requests.redact_batch_requests(Redactor(spark, FOUR), bodies, "body")
    kind = "results array<struct<redacted string>>, stats struct<items_processed int, total_lines int, total_patterns_matched int>"
    r = F.from_json("response", kind)
    return answered.select("conv_id", F.array_join(r["results"]["redacted"], "\n").alias("redacted"), r["stats"]["items_processed"].cast("long").alias("n_items"), r["stats"]["total_lines"].cast("long").alias("n_lines"))


def union_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = RuleSet.builtin().union(RuleSet.profiles("all")).to_df(spark)
    return both.groupBy("category", "profile").agg(F.count(F.lit(1)).alias("n_rules"), F.sum((F.col("literal") == "").cast("long")).alias("n_without_literal"))


def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BUILTIN.to_df(spark).select(F.col("rule_id").cast("long").alias("rule_id"), "name", "literal", "replacement")


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a file stream, redacted until the input is used up, read back from the sink."""
    from veilspark.sources.shared import shared_path
    from veilspark.streaming.streams import redact_table_stream

    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{source}*")
    target, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    done = redact_table_stream(Redactor(spark, FOUR), stream.select("doc_id", "text"), ["text"])
    done.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(target).withColumnRenamed("text", "redacted")


# What the cascade leaves: e-mail, address, card, number and ``gho_`` lines have no word of its gate.
_CASCADE_SQL = f"SELECT line_no, CASE WHEN line_no % {len(TEMPLATES)} IN (2, 3, 4, 5, 14) THEN value ELSE {chain_sql('value', BUILTIN)} END AS redacted FROM {_GENERATED_SQL}"
_FOUR_LINES = chain_sql("value", FOUR)
_BY_LINE_SQL = f"SELECT doc_id, string_agg({_FOUR_LINES}, chr(10) ORDER BY line_no) AS redacted FROM {_LINES_SQL} GROUP BY doc_id"


def _registered() -> dict[str, tuple[Query, str | None]]:
    four, tables = chain_sql("text", FOUR), {"documents": ("doc_id",), "conversations": ("conv_id", "turn"), "pages": ("page_id",)}
    out: dict[str, tuple[Query, str | None]] = {}
    for name, keys in tables.items():
        text = "html" if name == "pages" else "text"
        out[f"redact_chain_{name}"] = (partial(redact_table, table=name, keys=keys, text=text, rules=FOUR), f"SELECT {', '.join(keys)}, {chain_sql(text, FOUR)} AS redacted FROM {name}")
    for r in BUILTIN:
        one = RuleSet.of([r])
        out[f"redact_rule_{r.name}"] = (partial(redact_changed, rule=r), f"SELECT line_no, {chain_sql('value', one)} AS redacted FROM {_GENERATED_SQL} WHERE regexp_matches(value, {pattern_sql(r, 'value')})")
    any_four = " OR ".join(f"regexp_matches(text, {pattern_sql(r, 'text')})" for r in FOUR)
    email = RuleSet.of([BY_NAME["email"]])
    gate = " OR ".join(f"contains(text, {sql_string(r.literal)})" for r in BUILTIN if r.literal and r.literal != ".")
    out |= {
        "has_sensitive_flag": (has_sensitive_flag, f"SELECT doc_id, {any_four} AS has_sensitive FROM documents"),
        "lines_with_at": (lines_with_at, f"SELECT doc_id, line_no, value FROM {_LINES_SQL} WHERE contains(value, '@')"),
        "literal_gate": (literal_gate, f"SELECT doc_id FROM documents WHERE {gate}"),
        "rule_hit_counts": (rule_hit_counts, " UNION ALL ".join(f"SELECT {sql_string(r.name)} AS name, CAST(coalesce(sum({hits_sql('text', RuleSet.of([r]))}), 0) AS BIGINT) AS n_hits FROM documents" for r in BUILTIN)),
        "doc_hit_counts": (doc_hit_counts, f"SELECT doc_id, CAST({hits_sql('text', FOUR)} AS BIGINT) AS n_hits FROM documents"),
        "findings_emails": (findings_emails, f"SELECT doc_id, unnest(regexp_extract_all(text, {pattern_sql(email[0], 'text')})) AS match FROM documents"),
        "first_at": (first_at, "SELECT doc_id, CAST(strpos(text, '@') AS BIGINT) AS first_at FROM documents"),
        "first_email": (first_email, f"SELECT doc_id, CAST(CASE WHEN regexp_matches(text, {pattern_sql(email[0], 'text')}) THEN strpos(text, regexp_extract(text, {pattern_sql(email[0], 'text')})) ELSE 0 END AS BIGINT) AS first_email FROM documents"),
        "rule_lookup": (rule_lookup, "SELECT doc_id, tag, category, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, {sql_string(r.tag)} AS tag, {sql_string(r.category)} AS category, {hits_sql('text', RuleSet.of([r]))} AS n FROM documents" for r in FOUR) + ") WHERE n > 0"),
        "most_hits": (most_hits, f"SELECT doc_id, array_to_string(m, ' ') AS matches, CAST(len(m) AS BIGINT) AS n FROM (SELECT doc_id, list_slice(regexp_extract_all(text, {pattern_sql(BY_NAME['ipv4'], 'text')}), 1, 64) AS m FROM documents)"),
        "all_hits": (all_hits, f"SELECT doc_id, array_to_string(m, ' ') AS matches, CAST(len(m) AS BIGINT) AS n FROM (SELECT doc_id, regexp_extract_all(text, {pattern_sql(BY_NAME['ipv4'], 'text')}) AS m FROM documents)"),
        "split_lines": (split_lines_query, f"SELECT doc_id, line_no, value FROM {_LINES_SQL}"),
        "blank_lines": (blank_lines, f"SELECT doc_id, CAST(sum(CASE WHEN value = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blank FROM {_LINES_SQL} GROUP BY doc_id"),
        "line_stats": (line_stats, f"SELECT doc_id, count(*) AS n_lines, CAST(sum(strlen(value) + 1) - 1 AS BIGINT) AS n_bytes, CAST(max(strlen(value)) AS BIGINT) AS max_line_bytes FROM {_LINES_SQL} GROUP BY doc_id"),
        "over_long_lines": (over_long_lines, f"SELECT doc_id, line_no FROM {_LINES_SQL} WHERE strlen(value) > 2048"),
        "reassembled_documents": (reassembled, "SELECT doc_id, text FROM documents"),
        "redact_arrow_documents": (partial(redact_arrow, rules=FOUR), _BY_LINE_SQL),
        "redact_builtin_documents": (partial(redact_arrow, rules=BUILTIN), f"SELECT doc_id, string_agg({chain_sql('value', BUILTIN)}, chr(10) ORDER BY line_no) AS redacted FROM {_LINES_SQL} GROUP BY doc_id"),
        "redact_generated_native": (partial(redact_generated, path="native"), f"SELECT line_no, {chain_sql('value', BUILTIN)} AS redacted FROM {_GENERATED_SQL}"),
        "redact_generated_arrow": (partial(redact_generated, path="arrow"), f"SELECT line_no, {chain_sql('value', BUILTIN)} AS redacted FROM {_GENERATED_SQL}"),
        "redact_large_catalog": (redact_large_catalog, f"SELECT line_no, {chain_sql('value', BUILTIN)} AS redacted FROM {_GENERATED_SQL}"),
        "rule_examples": (rule_examples, _examples_sql()),
        "modified_flag": (modified_flag, f"SELECT d.doc_id, r.redacted <> d.text AS modified FROM documents d JOIN ({_BY_LINE_SQL}) r USING (doc_id)"),
        "findings_documents": (findings_documents, spans_sql(FOUR)),
        "findings_strings": (findings_strings, f"SELECT doc_id, unnest(regexp_extract_all(text, {pattern_sql(email[0], 'text')})) AS match FROM documents"),
        "merge_spans": (merge_spans, "SELECT id AS line_no, 'to [REDACTED:at_host] from [REDACTED:ipv4]' AS redacted, CAST(2 AS BIGINT) AS n_spans, CAST(3 AS BIGINT) AS n_hits FROM range(2000) t(id)"),
        "redact_cascade": (redact_cascade, _CASCADE_SQL),
        "redact_catalog_documents": (partial(redact_counted, rules=BUILTIN.union(RuleSet.categories())), None),
        "redact_cascade_documents": (partial(redact_counted, rules=BUILTIN, policy=Policy(mode="cascade")), None),
        "merge_spans_documents": (partial(redact_counted, rules=OVERLAPPING), None),
        "run_stats": (run_stats, f"SELECT count(*) AS lines_processed, CAST(sum(CASE WHEN r <> value THEN 1 ELSE 0 END) AS BIGINT) AS lines_modified, CAST(sum(h) AS BIGINT) AS patterns_matched, CAST(sum(s) AS BIGINT) AS spans, CAST(sum(strlen(value)) AS BIGINT) AS bytes_read, CAST(sum(strlen(r)) AS BIGINT) AS bytes_written, CAST({len(FOUR)} AS BIGINT) AS patterns_loaded FROM (SELECT value, {_FOUR_LINES} AS r, {hits_sql('value', FOUR)} AS h, len(regexp_extract_all({_FOUR_LINES}, '\\[REDACTED:')) AS s FROM {_LINES_SQL})"),
        "tag_counts": (tag_counts, f"SELECT doc_id, CAST(len(regexp_extract_all({four}, '\\[REDACTED:')) AS BIGINT) AS n_tags FROM documents"),
        "json_props": (json_props, "SELECT event_id, r AS props, json_extract_string(r, '$.k') AS k FROM (SELECT event_id, " + chain_sql("props", PROPS) + " AS r FROM events)"),
        "json_requests": (json_requests, f"SELECT c.conv_id, c.turn, {four} AS redacted, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all({four}, '\\[REDACTED:')) AS BIGINT) AS n_tags FROM conversations c"),
        "json_batches": (json_batches, f"SELECT conv_id, string_agg({four}, chr(10) ORDER BY turn) AS redacted, count(*) AS n_items, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM conversations GROUP BY conv_id"),
        "catalog_rules": (catalog_rules, " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS rule_id, {sql_string(r.name)} AS name, {sql_string(r.literal)} AS literal, {sql_string(r.tag)} AS replacement" for i, r in enumerate(BUILTIN))),
        "union_catalogs": (union_catalogs, "SELECT * FROM (VALUES " + ", ".join(f"({sql_string(c)}, {sql_string(p)}, CAST({n} AS BIGINT), CAST({m} AS BIGINT))" for c, p, n, m in _catalog_counts()) + ") t(category, profile, n_rules, n_without_literal)"),
        "stream_documents": (stream_documents, _BY_LINE_SQL),
        "redact_lines_native": (partial(reports.redacted_lines, rules=FOUR), _BY_LINE_SQL),
    }
    for p, redacted in _PROFILE_SQL.items():
        out[f"redact_profile_{p}"] = (partial(redact_profile, profile=p), f"SELECT id AS line_no, {redacted} AS redacted FROM range(1000) t(id)")
        out[f"redact_profile_{p}_documents"] = (partial(redact_counted, rules=RuleSet.profiles(p)), None)
    out |= reports.registered(FOUR, hits_sql)
    return out


def _catalog_counts() -> list[tuple[str, str, int, int]]:
    counts: dict[tuple[str, str], list[int]] = {}
    for r in RuleSet.builtin().union(RuleSet.profiles("all")):
        own = counts.setdefault((r.category, r.profile), [0, 0])
        own[0] += 1
        own[1] += not r.literal
    return [(c, p, n, m) for (c, p), (n, m) in counts.items()]


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _registered().items() if v[1]}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every built-in rule on every line of every document, with its counts."""
    done = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", result_udf(BUILTIN)("text").alias("r"))
    return done.select("doc_id", "lang", "source", "r.redacted", "r.modified", "r.n_spans", "r.n_hits")


__all__ = ["entry", "findings_udf", "generated_lines", "oracle_sql", "queries"]
