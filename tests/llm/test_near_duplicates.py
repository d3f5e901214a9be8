import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import DOC, MESSY, row
from veilspark.llm import near_duplicates as N
from veilspark.llm.common import WORD
from veilspark.llm.components import components


def brute(rows):
    """Per (id, text): the class as a set of row numbers, links, copies."""
    sets = []
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset((i, k) for k in [id(text)]) and frozenset())
    nodes = defaultdict(list)
    for k, s in enumerate(sets):
        nodes[s if s else ("blank", k)].append(k)
    keys = list(nodes)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = dict.fromkeys(keys, 0)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if isinstance(a, frozenset) and isinstance(b, frozenset) and 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    members = defaultdict(set)
    for k in keys:
        members[find(k)].update(nodes[k])
    return {r: (frozenset(members[find(k)]), links[k], len(nodes[k]) - 1) for k in keys for r in nodes[k]}


def _texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for k in range(n):
        base = r.choices(vocabulary, k=r.randint(6, 120))
        out.append(base)
        for _ in range(r.randint(0, 3)):
            near = list(base)
            for _ in range(r.randint(0, max(1, len(near) // 40))):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append(near)
    return [" ".join(x) for x in out]


def test_floor_reaches_the_recall():
    d = N.prefix_depth()
    assert (1 - 0.8**d) ** N.TREES <= N.MISS < (1 - 0.8 ** (d + 1)) ** N.TREES
    assert N.HEAD < d <= N.FULL_DEPTH and N.SKETCH <= N.VALUES


@pytest.mark.parametrize("small", [False, True])
def test_classes_are_brute_force(spark, monkeypatch, small):
    if small:  # blocks of a few rows: every bucket and unit is split
        for name in ("DENSE", "UNIT_NODES"):
            monkeypatch.setattr(N, name, 2)
    rows = [row(i, t) for i, t in enumerate(_texts(60, 3))]
    got = {r.doc_id: r for r in N.class_rows(spark.createDataFrame(rows, DOC)).collect()}
    assert len(got) == len(rows)
    for k, (members, links, copies) in brute(rows).items():
        assert (got[k].class_id, got[k].n_links, got[k].n_copies) == (min(members), links, copies)


def test_common_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(50)]
    got = N.common_counts(np.concatenate(sets), np.array(list(map(len, sets))))
    for i in range(50):
        for j in range(i + 1, 50):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (20, 10), (10, 20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 10, 20: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_messy(spark, messy, none):
    got = N.class_rows(messy).collect()
    assert len(got) == len(MESSY)
    kept = N.keep_one(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    expected = {v[0] for v in brute(MESSY).values()}
    assert len(rows) == len(expected)
    assert N.class_rows(none).count() == N.keep_one(none).count() == 0


def test_recall_with_the_sketch_reaches_the_target():
    same, bits = N.NUMERATOR / N.DENOMINATOR, N.SKETCH
    equal = (1 + same) / 2
    sketch = sum(math.comb(bits, k) * equal**k * (1 - equal) ** (bits - k) for k in range(N.MIN_EQUAL_BITS))
    assert N.MISS + sketch <= 1 - N.RECALL


def _near(words, share, r):
    """A text whose set has about the given similarity to that of ``words``."""
    n = len(words) - N.SHINGLE + 1
    changed = round((1 - share) / (1 + share) * n)  # shingles lost on either side
    own = list(words)
    for k in range(changed // N.SHINGLE):
        own[(k * len(own)) // max(1, changed // N.SHINGLE) + r.randrange(2)] = f"new{r.random()}"
    return own


@pytest.mark.parametrize("dense", [2048, 24])
def test_recall_near_the_threshold(spark, monkeypatch, dense):
    """Pairs at a similarity of 0.80 to 0.85, all of which brute force finds, among texts that share boilerplate."""
    monkeypatch.setattr(N, "DENSE", dense)
    r = random.Random(8)
    common = [f"b{i}" for i in range(60)]
    rows, links = [], 0
    while links < 2000:
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(140, 260))] + common
        near = _near(base, r.uniform(0.8, 0.85), r)
        a, b = (frozenset(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for x in (base, near))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [row(2 * links, " ".join(base)), row(2 * links + 1, " ".join(near))]
            links += 1
    got = N.class_rows(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    assert sum(x.n_links == 1 and x.class_id == x.doc_id // 2 * 2 for x in got) >= 0.9999 * len(got)


def test_units_follow_a_chain(spark):
    """A chain of near copies: every node stands in a few units, however long the chain is."""
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(3 * 3000 + 120)]
    nodes = N.describe(spark.createDataFrame([row(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(3000)], DOC)).withColumnRenamed("row", "node")
    groups = N.verification_groups(N.candidate_stars(nodes, []), nodes, []).selectExpr("node", "size(groups) AS n", "explode(groups.unit) AS unit")
    assert groups.selectExpr("avg(n)").first()[0] < 12
    assert groups.groupBy("unit").count().selectExpr("max(count)").first()[0] < 60
