"""Document fingerprints: SimHash, with permuted block tables for search within a Hamming radius.

Every word of a text votes with its own hash (weight 1) and with the hash of the pair it forms with the next word
(weight 3); a bit of the fingerprint is set when the signed sum of its votes is positive. The votes of two bits share one
64-bit sum, 32 bits each, so 64 sums give the 128 bits and the aggregation stays in generated code. Texts move once, into
ranges of ids; all words of a text are then in one task, so its sums need no shuffle.

Two fingerprints within a radius r differ in at most r of r + 2 blocks, so at least two blocks are equal: there is one
table for each choice of two blocks, keyed by their bits, and a pair is reported by the first table in which it meets.

Native: DataFrame and SQL functions only.

Defined results: a null text is empty; a text without words has the all-zero fingerprint; equal texts have equal
fingerprints; rows with equal ids are ordered by a hash of their text, so that they can be dealt over tasks; null ids
come first; a single document is its own successor; an empty table gives no rows; ids are integers (a text that is no
number raises); columns other than id and text are never read.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm.common import WORD_PATTERN, materialized, salted_join

WORDS_OF_64 = 2
BITS = 64 * WORDS_OF_64
WORD_WEIGHT, PAIR_WEIGHT = 1, 3
#: Characters of one task, ranges of ids that a task takes so that tasks come out even, and the most ranges; what is
#: collected or broadcast has a few numbers per range.
TASK_CHARS, TASK_RANGES, MOST_RANGES = 1 << 24, 8, 1 << 14
LANES = 0x0000000100000001
#: Hamming radius of the search, of 128 bits, and the ids whose documents are its queries: the multiples of this.
RADIUS, ASKED = 6, 20


def simhash(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Columns ``keys`` (unique together) and ``__fp0``, ``__fp1``: the fingerprint of ``text_col`` as two numbers."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    listed = texts.select(*keys, words.alias("__words"))
    zipped = F.arrays_zip(F.col("__words").alias("a"), F.slice("__words", F.lit(2), F.greatest(F.size("__words") - 1, F.lit(0))).alias("b"))
    terms = listed.select(*keys, F.inline_outer(zipped).alias("__a", "__b"))
    hashed = terms.select(
        *keys, F.col("__a").isNotNull().cast("long").alias("__n"),
        *(F.xxhash64(F.lit(k), "__a").alias(f"__h{k}") for k in range(WORDS_OF_64)),
        *(F.xxhash64(F.lit(k), "__a", F.coalesce("__b", F.lit(""))).alias(f"__g{k}") for k in range(WORDS_OF_64)),
    )
    lanes = F.lit(LANES)

    def votes(k: int, i: int) -> Column:
        word = F.shiftrightunsigned(f"__h{k}", i).bitwiseAND(lanes)
        pair = F.shiftrightunsigned(f"__g{k}", i).bitwiseAND(lanes)
        return F.sum(F.col("__n") * (WORD_WEIGHT * word + PAIR_WEIGHT * pair)).alias(f"__v{k}_{i}")

    sums = hashed.groupBy(*keys).agg(F.sum("__n").alias("__n"), *(votes(k, i) for k in range(WORDS_OF_64) for i in range(32)))
    half = (WORD_WEIGHT + PAIR_WEIGHT) * F.col("__n")

    def number(k: int) -> Column:
        bits = []
        for i in range(32):
            v = F.col(f"__v{k}_{i}")
            bits.append(F.shiftleft((2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) > half).cast("long"), i))
            bits.append(F.shiftleft((2 * F.shiftrightunsigned(v, 32) > half).cast("long"), i + 32))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return sums.select(*keys, *(number(k).alias(f"__fp{k}") for k in range(WORDS_OF_64)))


def as_text(name: str) -> Column:
    """A fingerprint as 32 lowercase hexadecimal digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(f"{name}{k}"), 16, "0") for k in range(WORDS_OF_64))))


def likeness(a: str, b: str) -> Column:
    """1 less the share of the bits in which two fingerprints differ."""
    return 1 - sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(WORDS_OF_64)), F.lit(0)) / F.lit(float(BITS))


def by_ranges(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows ``(doc_id, __text, __h0, __h1, __range)`` in the order of the ids, cut at their quantiles, and the number of tasks.

    Rows of one id that spans several ranges are cut by ``__h0``, which orders them, and so are those without an id.
    Only the quantiles of the ids reach the driver, ``MOST_RANGES`` numbers at most.
    """
    ids = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n, blank, chars = docs.agg(F.count(F.lit(1)), F.count_if(ids.isNull()), F.sum(F.length(text))).first()
    tasks = max(-(-(chars or 0) // TASK_CHARS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = max(1, min(MOST_RANGES, TASK_RANGES * tasks, n))
    steps = [k / ranges for k in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(ids, steps, F.lit(20 * ranges))).first()[0] if steps else []
    hashed = docs.select(ids.alias("doc_id"), text.alias("__text")).withColumns({"__h0": F.shiftrightunsigned(F.xxhash64("__text"), 1), "__h1": F.xxhash64(F.lit(1), "__text")})
    share = F.col("__h0").cast("double") / F.lit(2.0**63)
    nulls = max(1, math.ceil(ranges * blank / max(1, n)))
    apart = F.least(F.floor(share * nulls), F.lit(nulls - 1)) - nulls
    if not bounds:
        place = F.lit(0).cast("long")
    else:
        known = F.array(*map(F.lit, bounds))
        halves = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

        def passed(equal: bool) -> Column:
            """How many bounds are below the id (or equal to it), by halving."""

            def step(at: Column, by: Column) -> Column:
                bound = F.get(known, at + by - 1)
                return F.when((bound <= F.col("doc_id")) if equal else (bound < F.col("doc_id")), at + by).otherwise(at)

            return F.aggregate(halves, F.lit(0), step)

        low, many = passed(False), passed(True) - passed(False)
        place = low + F.least(F.floor(share * (many + 1)), many)
    return hashed.withColumn("__range", F.when(F.col("doc_id").isNull(), apart).otherwise(place).cast("int")), tasks


def range_heads(ranged: DataFrame) -> DataFrame:
    """A row for each range that has rows: ``__of``, the range before it (the last for the first), and its first row's keys."""
    order = ["doc_id", "__h0", "__h1"]
    firsts = ranged.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), *order)).alias("f"))
    every = W.orderBy("__range")  # one row per range, at most twice MOST_RANGES of them
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag("__range").over(every), F.max("__range").over(whole))
    return firsts.select(before.alias("__before"), F.col("__range").alias("__of"), *(F.col(f"f.{c}").alias(f"__first{c}") for c in order))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and how alike they and the next document's are.

    ``near_docs`` is for every ``ASKED``-th id the number of other documents, all of them searched by the block tables,
    whose fingerprint is within ``RADIUS`` bits; null for other documents. The edited text replaces the last quarter of the
    code points by as many of the next document's first ones.
    """
    ranged, tasks = by_ranges(docs, id_col, text_col)
    heads = materialized(range_heads(ranged), "heads")
    # The first text of each range goes to the last row of the range before.
    same = F.col("doc_id").eqNullSafe(F.col("__firstdoc_id")) & (F.col("__h0") == F.col("__first__h0")) & (F.col("__h1") == F.col("__first__h1"))
    first_texts = ranged.join(F.broadcast(heads), (F.col("__range") == F.col("__of")) & same).groupBy("__before").agg(F.min("__text").alias("__head"))
    own = W.partitionBy("__range").orderBy(F.col("doc_id").asc_nulls_first(), "__h0", "__h1")
    dealt = ranged.repartition(tasks, "__range")
    led = dealt.select("__range", "doc_id", "__text", F.lead("__text").over(own).alias("__lead"), F.row_number().over(own).alias("__nth"))
    led = led.join(first_texts, F.col("__range") == F.col("__before"), "left")
    n = F.length("__text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), n - quarter), F.substring(F.coalesce("__lead", "__head"), F.lit(1), quarter))
    both = led.select("__range", "__nth", "doc_id", n.cast("long").alias("n_chars"), "__text", edited.alias("__edited")).withColumn("__sha", F.sha2("__edited", 256))
    # One row per text and kind; the place in its range tells repeated rows apart.
    keys = ["__range", "__nth", "doc_id", "n_chars", "__sha"]
    kinds = both.select(*keys, F.inline(F.array(F.struct(F.lit(0).alias("__kind"), F.col("__text").alias("__t")), F.struct(F.lit(1).alias("__kind"), F.col("__edited").alias("__t")))).alias("__kind", "__t"))
    prints = simhash(kinds, [*keys, "__kind"], "__t")
    pairs = prints.groupBy(*keys).agg(
        *(F.max(F.when(F.col("__kind") == kind, F.col(f"__fp{k}"))).alias(f"{name}{k}") for kind, name in ((0, "__own"), (1, "__edit")) for k in range(WORDS_OF_64))
    )
    pairs = materialized(pairs, "fingerprints")
    numbers = [f"__own{k}" for k in range(WORDS_OF_64)]
    after = F.struct(*numbers)
    first_prints = pairs.where("__nth = 1").select("__range", after.alias("__head")).join(F.broadcast(heads.select("__before", F.col("__of").alias("__range"))), "__range").drop("__range")
    followed = pairs.withColumn("__lead", F.lead(after).over(W.partitionBy("__range").orderBy("__nth")))
    followed = followed.join(F.broadcast(first_prints), F.col("__range") == F.col("__before"), "left").withColumn("__next", F.coalesce("__lead", "__head"))
    followed = followed.select("*", *(F.col(f"__next.__own{k}").alias(f"__following{k}") for k in range(WORDS_OF_64)))
    asked = F.col("doc_id") % ASKED == 0
    found = near_counts(pairs, numbers, asked)
    spread = followed.withColumn("__place", F.struct("__range", "__nth"))
    followed = salted_join(spread, found, numbers, "__place", "left").withColumn("near_docs", F.when(asked, F.col("near_docs")))
    return followed.select(
        "doc_id", "n_chars", F.col("__sha").alias("edited_sha256"), as_text("__own").alias("fingerprint"), as_text("__edit").alias("edited_fingerprint"),
        likeness("__own", "__edit").alias("near_edited"), likeness("__own", "__following").alias("near_next"), "near_docs",
    )


def _pieces(block: int, n: int) -> list[tuple[int, int, int]]:
    """The parts of one of ``n`` blocks as (number, shift, mask): a block may lie across two numbers."""
    size = -(-BITS // n)
    low, high, out = block * size, min(BITS, (block + 1) * size), []
    for k in range(WORDS_OF_64):
        a, b = max(low, 64 * k), min(high, 64 * (k + 1))
        if a < b:
            out.append((k, 64 * (k + 1) - b, (1 << (b - a)) - 1))
    return out


def _block(numbers: list[Column], block: int, n: int) -> list[Column]:
    return [F.shiftrightunsigned(numbers[k], shift).bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)) for k, shift, mask in _pieces(block, n)]


def block_tables(prints: DataFrame, names: list[str], radius: int = RADIUS) -> DataFrame:
    """``prints`` repeated for every table: ``__table``, and ``__key``, a hash of the table and the bits of its two blocks."""
    n, numbers = radius + 2, [F.col(x) for x in names]
    entries = [
        F.struct(F.lit(t).alias("__table"), F.xxhash64(F.lit(t), *_block(numbers, a, n), *_block(numbers, b, n)).alias("__key")) for t, (a, b) in enumerate(combinations(range(n), 2))
    ]
    return prints.select("*", F.inline(F.array(*entries)).alias("__table", "__key"))


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of a query's and another distinct fingerprint within the radius.

    Both inputs have columns ``__fp0`` and ``__fp1`` and are counted first, so copies never meet each other.
    Returns ``q0, q1, f0, f1, n, distance``, ``n`` the rows of ``prints`` with that fingerprint; fingerprints equal to the
    query are included with distance 0.
    """
    n = radius + 2
    q = block_tables(queries.select(F.col("__fp0").alias("q0"), F.col("__fp1").alias("q1")).distinct(), ["q0", "q1"], radius).withColumnRenamed("__table", "__qt")
    counted = prints.groupBy(F.col("__fp0").alias("f0"), F.col("__fp1").alias("f1")).agg(F.count(F.lit(1)).alias("n"))
    f = block_tables(counted, ["f0", "f1"], radius)
    odd = [F.col(f"q{k}").bitwiseXOR(F.col(f"f{k}")) for k in range(WORDS_OF_64)]
    distance = sum((F.bit_count(x) for x in odd), F.lit(0))
    same = [reduce(lambda a, b: a & b, (x == 0 for x in _block(odd, k, n))) for k in range(n)]
    # The first table of a pair is that of its first two equal blocks.
    tables = list(combinations(range(n), 2))
    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        first = F.when(same[tables[t][0]] & same[tables[t][1]], F.lit(t)).otherwise(first)
    # A sort-merge join at every size: the queries grow with the data, so whether they could be broadcast must not decide.
    met = q.join(f.hint("merge"), (q["__key"] == f["__key"]) & (F.col("__qt") == F.col("__table")) & (distance <= radius) & (first == F.col("__table")))
    return met.select("q0", "q1", "f0", "f1", "n", distance.cast("int").alias("distance"))


def near_counts(rows: DataFrame, names: list[str], asked: Column, radius: int = RADIUS) -> DataFrame:
    """Columns ``names`` (distinct) and ``near_docs``: for the rows that are ``asked``, other rows within the radius."""
    as_print = [F.col(x).alias(f"__fp{k}") for k, x in enumerate(names)]
    met = near(rows.where(asked).select(*as_print), rows.select(*as_print), radius)
    sums = met.groupBy("q0", "q1").agg((F.sum("n") - 1).alias("near_docs"))
    return sums.select(*(F.col(f"q{k}").alias(x) for k, x in enumerate(names)), "near_docs")
