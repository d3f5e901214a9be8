import math
import random
import re
import time

import pyarrow as pa
import pytest

from tests.llm.conftest import DOC, LONG, MESSY, PROSE, row
from veilspark.llm import licenses

INDEX = licenses.LicenseIndex()
MIT = dict((x[1][:20], x[1]) for x in licenses.TEMPLATES if x[0] == "mit")["permission is hereby"]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def scan(text, index=INDEX):
    coded, bounds = licenses.word_lists(pa.array([text], pa.string()))
    assert bounds.tolist() == [0, len(words_of(text))] and [coded.dictionary[i.as_py()].as_py() for i in coded.indices] == words_of(text)
    return index.scan(index.codes(coded))


def stands(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def brute_base(text):
    words = words_of(text)
    found = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in stands(words, phrase.split())]
    return sorted(i for i, _ in found), {label for _, label in found}


def brute_labels(text, index=INDEX):
    """Every start of every template, in plain Python."""
    words, names = words_of(text), list(index.vocabulary)
    labels, score = brute_base(text)[1], 0.0
    score = licenses.BASE_SCORE if labels else 0.0
    for t, (label, own, keys) in enumerate(licenses.TEMPLATES):
        own, idf = own.split(), {w: float(index.idf[i]) for w, i in index.vocabulary.items()}
        rare, drift = {names[w] for w in index.rare[t]}, max(licenses.DRIFT, len(own) // 10)
        votes = {w: sorted({i - o for i, x in enumerate(words) if x == w for o, y in enumerate(own) if y == w}) for w in rare}
        for s in sorted({s for x in votes.values() for s in x}):
            met = sum(idf[w] for w, x in votes.items() if any(s <= v <= s + drift for v in x))
            if met < licenses.MIN_SHARE * sum(idf[w] for w in rare) - 1e-9:
                continue
            if not all(any(s - drift <= i <= s + len(own) + drift - len(k.split()) for i in stands(words, k.split())) for k in keys):
                continue
            here = sum(idf[w] for o, w in enumerate(own) if any(0 <= p < len(words) and words[p] == w for p in range(s + o - drift, s + o + drift + 1)))
            share = here / sum(idf[w] for w in own)
            if share >= licenses.MIN_COVERAGE - 1e-9:
                labels.add(label)
                score = max(score, share)
    return labels, min(1.0, score)


TEXTS = [
    None, "", PROSE, LONG, "CC-BY cc by; CC BY-NC 4.0", "All Rights\nReserved. all rights reserved", "GNU General Public License, version 3 GENERAL PUBLIC LICENSE",
    "cc é by", "cc by", "ccby cc_by cc1by", "cc by cc by cc by", "ALL RIGHTS RESERVED" * 3, "İcc by", "general public licensee", "\x00cc\x7fby\x1f",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_is_brute_force(text):
    places, base = scan(text)[:2]
    assert (places.tolist(), base) == brute_base(text)


def _mixed(r):
    """Parts of templates, whole or cut or spoilt, with prose around."""
    parts = []
    for _ in range(r.randint(1, 4)):
        own = r.choice(licenses.TEMPLATES)[1].split()
        a = r.choice((0, 0, r.randrange(len(own))))
        own = own[a : r.choice((len(own), len(own), a + r.randint(1, len(own))))]
        own = [w for w in own if r.random() > 0.03]
        for _ in range(r.randint(0, 3)):
            own.insert(r.randint(0, len(own)), r.choice(("the", "software", "x", "license")))
        parts += own + PROSE.split()[: r.randint(0, 12)]
    return " ".join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_labels_are_brute_force(seed):
    r = random.Random(seed)
    text = _mixed(r)
    frequency = {"": 5000, "the": 4900, "license": 400, "software": 300, "mit": 40, "is": 3000} if seed % 2 else None
    index = licenses.LicenseIndex(frequency)
    _, _, labels, score, spans = scan(text, index)
    expected = brute_labels(text, index)
    assert labels == expected[0] and math.isclose(score, expected[1], abs_tol=1e-9)
    assert {x[0] for x in spans} <= labels and all(0 <= a < b <= len(words_of(text)) for _, a, b in spans)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), (MIT, "mit"), (f"Copyright 2020 A. Body\n\n{MIT.replace(' the above', chr(10) + ' The above')}", "mit"),
        *((x[1], x[0]) for x in licenses.TEMPLATES),
    ],
)
def test_templates(text, label):
    for around in (text, f"{PROSE}\n{text}\n{PROSE}"):
        labels, score = scan(around)[2:4]
        assert label in labels and 0.9 <= score <= 1


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Apache License Version 2.0, January 2004", "apache-2.0"), ("MIT License, Copyright (c) 2020", "mit"), ("GNU General Public License, version 3", "gpl-3.0"),
        ("GNU Lesser General Public License", "lgpl"), ("CC BY-SA 4.0", "cc-by-sa-4.0"), ("under the Apache License, Version 2.0", "apache-2.0"),
    ],
)
def test_texts_that_open_in_the_middle_of_a_template(text, label):
    alone, later = scan(text), scan(f"{PROSE}\n{text}")
    assert label in alone[2] and label in later[2] and alone[3] > licenses.BASE_SCORE
    assert any(x[0] == label and x[1] <= 2 for x in alone[4])


def test_a_borrowed_opening_is_no_licence():
    own = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to read the Software for private study. "
        "You may not use the Software in production, offer it as a service, or share it with others, without a written agreement with the company. The company may end this permission at any time."
    )
    assert "mit" not in scan(own)[2] and scan(own)[3] < licenses.MIN_COVERAGE


def test_clean_texts_have_no_label():
    assert scan(PROSE)[2] == set() and scan(PROSE)[3] == 0
    assert "mit" not in scan("He went to MIT. The license was released.")[2]
    assert "gpl-2.0" not in scan("This work is licensed under the GNU General Public License, version 3.")[2]


def test_common_words_are_not_indexed():
    index = licenses.LicenseIndex({"": 100_000, "the": 90_000, "software": 20_000, "license": 8_000, "a": 80_000, "is": 70_000, "to": 60_000})
    names = list(index.vocabulary)
    assert not {names[w] for x in index.rare for w in x} & {"the", "a", "is", "to", "software"}
    assert all(len(x) >= licenses.FEW_WORDS or len(x) == len(set(own.tolist())) for x, own in zip(index.rare, index.words, strict=True))


@pytest.mark.parametrize("word", ["license ", "mit ", "mit license ", "released "])
def test_a_word_over_and_over(word):
    began = time.process_time()
    scan_only = licenses.word_lists(pa.array([word * (1_000_000 // len(word))]))
    INDEX.scan(INDEX.codes(scan_only[0]))
    assert time.process_time() - began < 2


def test_table(spark, messy, none):
    got = licenses.scan_documents(messy).collect()
    assert len(got) == len(MESSY) and all(0 <= r.score <= 1 for r in got)
    texts = {r[0]: r[1] for r in MESSY if r[0] not in (1, None)}
    assert all(r.n_words == len(words_of(texts[r.doc_id])) for r in got if r.doc_id in texts)
    assert licenses.scan_documents(none).count() == 0


def test_table_is_brute_force(spark):
    rows = [row(i, _mixed(random.Random(100 + i))) for i in range(30)] + [row(99, None), row(98, "")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    index = licenses.LicenseIndex(licenses.word_frequencies(docs))
    assert index.share["mit"] == sum("mit" in words_of(r[1]) for r in rows) / (len(rows) + licenses.PRIOR)
    for r in licenses.scan_documents(docs).collect():
        text = dict((x[0], x[1]) for x in rows)[r.doc_id]
        labels, score = brute_labels(text, index)
        places, base = brute_base(text)
        assert r.labels == ",".join(sorted(labels)) and math.isclose(r.score, score, abs_tol=1e-9) and r.base_labels == ",".join(sorted(base))
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))
