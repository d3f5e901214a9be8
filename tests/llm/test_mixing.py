from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import DOC, MESSY, row
from veilspark.llm import mixing
from veilspark.llm.common import WORD


def fill(sizes, weights, cap=3.0):
    """Water-filling by rounds: clamp what is above, share the rest again."""
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weights[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.repeats <= 3
        taken[r.source] += r.size * r.repeats
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    import random

    r = random.Random(seed)
    sources = ["a", "b", "ü", "zz", None, "c"][: 3 + seed % 4]
    rows = [row(i, "w " * r.randint(0, 60), source=r.choices(sources, [50, 3, 9, 1, 5, 2][: len(sources)])[0]) for i in range(400)]
    check(rows, mixing.plan_mix(spark.createDataFrame(rows, DOC)).collect())


def test_messy(spark, messy, none):
    got = mixing.plan_mix(messy).collect()
    assert len(got) == len(MESSY)
    check(MESSY, got)
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns and mixed.count() == sum(r.repeats for r in got)
    assert mixing.plan_mix(none).count() == mixing.mix(none).count() == 0


def test_no_words(spark):
    rows = [row(1, ""), row(2, None, source="b")]
    assert {(r.target, r.repeats * r.size) for r in mixing.plan_mix(spark.createDataFrame(rows, DOC)).collect()} == {(0.0, 0)}


def test_reruns_agree(spark, messy):
    one = sorted(map(str, mixing.plan_mix(messy).collect()))
    assert one == sorted(map(str, mixing.plan_mix(messy.repartition(7)).collect()))


def test_mixes_agree_with_repeated_and_null_ids(spark):
    """The texts that a mix takes are the same however the rows are dealt."""
    rows = [row(i % 7 or None, f"text {i % 90} of source " + "w " * (i % 13), source="ab"[i % 9 > 0], lang=str(i % 4)) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    one = Counter(map(str, mixing.mix(docs).collect()))
    assert len(one) < sum(one.values())
    for parts in (1, 5, 13):
        assert one == Counter(map(str, mixing.mix(docs.orderBy("n_chars").repartition(parts)).collect()))


def test_rows_of_one_id_fall_in_many_ranges(spark):
    rows = [row(None if i % 2 else 5, f"text {i}") for i in range(600)]
    planned = mixing.plan_mix(spark.createDataFrame(rows, DOC), weights=(1.0,))
    assert planned.count() == 600 and {r.repeats for r in planned.collect()} == {1}


def test_many_sources_meet_by_salted_keys(spark, messy, monkeypatch):
    few = sorted(map(str, mixing.plan_mix(messy).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert few == sorted(map(str, mixing.plan_mix(messy).collect()))
