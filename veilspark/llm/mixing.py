"""Mixing sources to target weights: capped water-filling.

Source ``s`` with weight ``w`` wants ``level * w`` words; it is clamped at ``max_epochs`` times its size and the excess
goes to the others by weight until none is above. The level has a closed form: with the sources in ascending order of
cap / weight, the first ``k`` are clamped, where ``k`` is the least count for which the next one's cap / weight reaches
``(total - caps of the first k) / weights of the others``.

A source's rate is target / size: every document is taken floor(rate) times, and the documents that come first by a
seeded digest of their id and text are taken once more, until the fraction of the source's words is met to half a
document. The digests are summed in 65,536 ranges by map-side aggregation, so only the one range where a source's cut
falls is ordered. Repeated or null ids have digests of their own where their texts differ.

Native: DataFrame and SQL functions only.

Defined results: a null text has no words; the null source is the last source; documents without words are taken
floor(rate) or floor(rate) + 1 times like others but add no words; rows of equal id and text are ordered by a hash of all
columns in ``mix``, so that reruns agree, and are alike in ``plan_mix``; when no document has a word every target is 0; an
empty table gives no rows; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm.common import WORD_PATTERN, materialized, quoted

SEED = "mix-1"
MAX_EPOCHS = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
#: Digest ranges of a source: the first four hex digits.
RANGE_DIGITS = 4
#: Sources up to which their targets are broadcast, and the parts into which rows of a source are dealt beyond.
BROADCAST_SOURCES, SALTS = 20_000, 64


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """``(source, source_size, weight)`` with ``target`` added. One row per source, so its windows have no partition."""
    by_cap = W.orderBy("__full", "__rank")
    filled = (
        sources.withColumn("__cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("__full", F.col("__cap") / F.col("weight"))
        .withColumn("__rank", F.row_number().over(W.orderBy("__full", F.col("source").asc_nulls_last())))
        .withColumn("__caps", F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__weights", F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("__total", F.lit(share) * F.sum("source_size").over(W.partitionBy()))
        .withColumn("__level", (F.col("__total") - F.col("__caps")) / F.col("__weights"))
    )
    # The first source whose cap reaches the level of those from it on fixes the level; earlier ones are clamped.
    level = F.min(F.when(F.col("__full") >= F.col("__level"), F.struct("__rank", "__level"))).over(W.partitionBy())["__level"]
    filled = filled.withColumn("__final", level)
    target = F.when(F.col("__final").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__final") * F.col("weight")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weights by the order of the sources' code points, null last, repeating."""
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, repeats, and the columns of ``keep``."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    kept = F.struct(*(F.col(c) for c in quoted(list(keep)))) if keep else F.lit(None)
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("__size"), digest.alias("__digest"), kept.alias("__kept"),
    ).withColumn("__range", F.substring("__digest", 1, RANGE_DIGITS))
    if not keep:  # a few numbers a row, written so that texts are read once
        rows = materialized(rows.drop("__kept"), "sizes").withColumn("__kept", F.lit(None))
    # At most 65,536 rows per source, summed before the shuffle and written once: all that follows but the last pass reads them.
    ranges = materialized(rows.groupBy("__source", "__range").agg(F.sum("__size").alias("__words")), "ranges")
    sums = ranges.groupBy("__source").agg(F.sum("__words").cast("double").alias("source_size"))
    filled = water_fill(weigh(sums.withColumnRenamed("__source", "source"), weights), max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = filled.select(
        F.col("source").alias("__s"), "source_size", "target",
        F.least(F.floor(rate), F.lit(int(max_epochs))).alias("__whole"), (F.col("target") - F.floor(rate) * F.col("source_size")).alias("__extra"),
    )
    # The range in which a source's words reach the extra ones, and the words of the ranges before it: first among the
    # ranges of two digits, then among those of four within the one found, so that a window has 256 rows at most.
    wanted = targets.select("__s", "__extra", F.lit(0).cast("long").alias("__passed"))
    first = _cut(ranges.groupBy("__source", F.substring("__range", 1, RANGE_DIGITS // 2).alias("__part")).agg(F.sum("__words").alias("__words")), wanted)
    inner = ranges.join(first.select(F.col("__s").alias("__f"), "__at"), F.col("__source").eqNullSafe(F.col("__f")) & (F.substring("__range", 1, RANGE_DIGITS // 2) == F.col("__at")))
    second = _cut(inner.select("__source", F.col("__range").alias("__part"), "__words"), first.select("__s", "__extra", F.col("__before").alias("__passed")))
    cuts = second.select(F.col("__s").alias("__c"), "__at", "__before")
    targets = materialized(targets.join(cuts, F.col("__s").eqNullSafe(F.col("__c")), "left").drop("__c"), "targets")
    joined = _with_targets(rows, targets)
    at = F.col("__at")
    inside = at.isNotNull() & (F.col("__range") == at)
    outer = joined.where(~inside).withColumn("__more", F.when(at.isNull() | (F.col("__range") < at), 1).otherwise(0))
    order = W.partitionBy("__source").orderBy("__digest", *([F.xxhash64("__kept")] if keep else [])).rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("__before") + F.sum("__size").over(order) - F.col("__size") / 2
    inner = joined.where(inside).withColumn("__more", F.when(middle < F.col("__extra"), 1).otherwise(0))
    repeats = F.least(F.col("__whole") + F.col("__more"), F.lit(int(max_epochs))).cast("long")
    return outer.unionByName(inner).select(
        F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__size").alias("size"),
        F.col("source_size").cast("long").alias("source_size"), "target", repeats.alias("repeats"), *([F.col("__kept")] if keep else []),
    )


def _cut(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source the first part at which the words passed so far exceed the extra ones: ``__s, __extra, __at, __before``.

    A source whose words never exceed them has no row.
    """
    running = F.sum("__words").over(W.partitionBy("__source").orderBy("__part"))
    met = parts.withColumn("__sum", running).join(wanted, F.col("__source").eqNullSafe(F.col("__s")))
    over = met.where(F.col("__passed") + F.col("__sum") > F.col("__extra"))
    found = over.groupBy("__s", "__extra").agg(F.min(F.struct("__part", (F.col("__passed") + F.col("__sum") - F.col("__words")).alias("b"))).alias("c"))
    return found.select("__s", "__extra", F.col("c.__part").alias("__at"), F.col("c.b").alias("__before"))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with the target of their source. Few sources are broadcast, after a count; many are met by salted keys."""
    if targets.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(targets), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salted", F.pmod(F.xxhash64("__digest"), F.lit(SALTS)))
    return dealt.join(salted, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__salted") == F.col("__salt"))).drop("__s", "__salt", "__salted")


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed documents: every row repeated as planned, with the columns of ``docs``."""
    planned = plan_mix(docs, keep=tuple(docs.columns), **options)
    copies = planned.where("repeats > 0").select("__kept", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return copies.select("__kept.*")
