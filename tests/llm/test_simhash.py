import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import DOC, MESSY, PROSE, row
from veilspark.llm import simhash
from veilspark.llm.common import WORD


def edited(rows):
    """Rows in order of id (null first), then hashes of the text, with their edited texts."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) >> 1))
    out = []
    for k, (i, t) in enumerate(rows):
        n = len(t) // 4
        out.append((i, t, t[: len(t) - n] + rows[(k + 1) % len(rows)][1][:n]))
    return out


def brute_print(text):
    """The fingerprint by votes, one bit at a time."""
    words = WORD.findall(text)
    out = 0
    for k in range(simhash.WORDS_OF_64):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", k), 42)
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed) for w in words]
        pairs = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(hashes, [*words[1:], ""], strict=False)]
        for bit in range(64):
            votes = sum(simhash.WORD_WEIGHT * (1 if h >> bit & 1 else -1) for h in hashes) + sum(simhash.PAIR_WEIGHT * (1 if h >> bit & 1 else -1) for h in pairs)
            out |= (votes > 0) << (64 * (simhash.WORDS_OF_64 - 1 - k) + bit)
    return f"{out:032x}"


def test_bits_are_brute_force(spark):
    r = random.Random(6)
    texts = ["", "one", "one two", "é 日本 é", PROSE, " \n ", *(" ".join(r.choices(["a", "b", "cd", "é"], k=r.randint(1, 60))) for _ in range(40))]
    got = simhash.fingerprint_edits(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOC)).collect()
    edits = {i: e for i, _, e in edited([row(i, t) for i, t in enumerate(texts)])}
    for x in got:
        assert x.fingerprint == brute_print(texts[x.doc_id]) and x.edited_fingerprint == brute_print(edits[x.doc_id])


def check(got, rows):
    expected = edited(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    have = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key)
    assert have == sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in expected), key=key)
    by_text = {}
    for r in got:
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(1 - bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1") / 128)
        assert 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    for r in got:
        near = sum(bin(int(r.fingerprint, 16) ^ int(x.fingerprint, 16)).count("1") <= simhash.RADIUS for x in got) - 1
        assert r.near_docs == (near if r.doc_id is not None and r.doc_id % simhash.ASKED == 0 else None)


def test_messy(spark, messy, none, monkeypatch):
    check(simhash.fingerprint_edits(messy).collect(), MESSY)
    monkeypatch.setattr(simhash, "TASK_CHARS", 1000)
    check(simhash.fingerprint_edits(messy).collect(), MESSY)
    assert simhash.fingerprint_edits(none).count() == 0


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_CHARS", 50)
    r = random.Random(2)
    ids = r.sample(range(-(10**12), 10**12), 40) + list(range(50)) + [2**62, -(2**62)]
    rows = [row(i, f"é{'x y ' * (k % 9)}{i}") for k, i in enumerate(ids)]
    got = simhash.fingerprint_edits(spark.createDataFrame(rows, DOC)).collect()
    check(got, rows)
    prints = {x.doc_id: x.fingerprint for x in got}
    order = sorted(ids)
    for x in got:
        after = order[(order.index(x.doc_id) + 1) % len(order)]
        assert x.near_next == pytest.approx(1 - bin(int(x.fingerprint, 16) ^ int(prints[after], 16)).count("1") / 128)


def test_one_outlier_and_one_hot_id(spark, monkeypatch):
    """Ids are cut at their quantiles, and rows of one id or of none by a hash: no range is much larger than others."""
    monkeypatch.setattr(simhash, "TASK_CHARS", 200_000)
    n, hot = 100_000, 30_000
    ids = F.when(F.col("id") == 0, F.lit(2**62)).when(F.col("id") < hot, F.lit(77)).when(F.col("id") < 2 * hot, F.lit(None)).otherwise(F.col("id"))
    docs = spark.range(n).select(ids.cast("long").alias("doc_id"), F.concat(F.lit("text of a row "), "id").alias("text"))
    ranged, tasks = simhash.by_ranges(docs, "doc_id", "text")
    sizes = sorted(r["count"] for r in ranged.groupBy("__range").count().collect())
    assert 50 < len(sizes) and sizes[-1] <= 3 * sizes[len(sizes) // 2] and sum(sizes) == n
    spans = ranged.groupBy("__range").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a is not null").orderBy("__range").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:], strict=False))


def test_extreme_ids(spark):
    rows = [row(i, f"text number {i}") for i in (-(2**63), 2**63 - 1, 0)]
    check(simhash.fingerprint_edits(spark.createDataFrame(rows, DOC)).collect(), rows)


def test_one_document(spark):
    got = simhash.fingerprint_edits(spark.createDataFrame([row(5, "abcdefgh")], DOC)).first()
    assert got.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and got.near_next == 1


@pytest.mark.parametrize("radius", [6, 3, 9])
def test_block_tables_find_all(spark, radius):
    r = random.Random(4)
    seeds = [r.getrandbits(128) for _ in range(6)]
    values = list({s ^ sum(1 << b for b in r.sample(range(128), r.randint(0, 9))) for s in seeds for _ in range(12)} | set(seeds))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in values], "__fp0 long, __fp1 long")
    queries = df.limit(20)
    asked = {((r[0] % 2**64) << 64) | (r[1] % 2**64) for r in queries.collect()}
    got = {(((x.q0 % 2**64) << 64) | (x.q1 % 2**64), ((x.f0 % 2**64) << 64) | (x.f1 % 2**64)): x.distance for x in simhash.near(queries, df, radius).collect()}
    expected = {(a, b): bin(a ^ b).count("1") for a in asked for b in values if bin(a ^ b).count("1") <= radius}
    assert got == expected
