import math
import os
import unicodedata
import zlib

import pytest

from tests.llm.conftest import MESSY
from veilspark.llm import language

SF = "/root/testdata/sf0.01"


def test_messy(spark, messy, none):
    model = language.fit(messy)
    got = language.predict_documents(messy, model).collect()
    assert len(got) == len(MESSY)
    for r, (i, text, *_) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), sorted(MESSY, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 9)} == {"und"}
    assert language.keep_known(messy, model).columns == messy.columns
    empty = language.fit(none)
    assert empty.languages == () and language.predict_documents(none, empty).count() == 0
    assert {r.lang_pred for r in language.predict_documents(messy, empty).collect()} == {"und"}


def test_long_texts_are_read_whole():
    model = language.LanguageModel(("a", "b"), language.np.random.default_rng(1).normal(size=(2, language.BUCKETS)).astype("float32"), language.np.zeros(2), 0.0)
    text = "some words stand here " * 3000
    whole = model.predict(text)
    old, language.CHUNK = language.CHUNK, 1000
    try:
        assert model.predict(text) == (whole[0], pytest.approx(whole[1], abs=1e-6))
    finally:
        language.CHUNK = old


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predict_documents(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98
    assert sum(r.accepted for r in rows) / len(rows) >= 0.99
    assert language.keep_known(docs, language.fit(docs)).count() >= 0.99 * docs.where("text is not null").count()


#: Program code, data, and languages that the tables do not hold.
FOREIGN = {
    "code": 'def main(argv):\n    for i in range(len(argv)):\n        if argv[i].startswith("--"):\n            opts[argv[i][2:]] = True\n    return [x for x in os.listdir(path) if x.endswith(".py")]\n' * 5,
    "braces": "public static void main(String[] args) { for (int i = 0; i < args.length; i++) { System.out.println(args[i]); } }\n" * 6,
    "data": '{"id": 123, "name": "xyz", "values": [1, 2, 3], "flag": true}' * 10,
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 3,
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. " * 3,
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 3,
    "chinese": "人人生而自由，在尊严和权利上一律平等。" * 10, "base64": "dGhlIHF1aWNrIGJyb3duIGZveCBqdW1wcyBvdmVyIHRoZSBsYXp5IGRvZw" * 6,
    "consonants": " ".join("".join("qwrtzpsdfghjklxcvbnm"[(i * 7 + k * k) % 20] for k in range(7)) for i in range(80)),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_other_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(FOREIGN.values())]
    foreign = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert language.keep_known(foreign, model).count() == 0
    assert all(r.lang_pred in model.languages and not r.accepted for r in language.predict_documents(foreign, model).collect())


def test_labels_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, f"some words of text number {i}", ["a", "a", "b", "b", f"odd{i}"][i % 5]) for i in range(100)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("a", "b")


def naive(model, text):
    """Language, probability and deviation, with one subword at a time."""
    if text is None or not model.languages or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0, -math.inf
    kept = "".join(c if "a" <= c <= "z" or not c.isascii() and not language.NO_LETTERS.fullmatch(c) else " " for c in text.lower())
    data = f" {' '.join(kept.split())} ".encode()
    found = []
    for order in language.ORDERS:
        for i in range(len(data) - order + 1):
            h = (0x811C9DC5 + order) & 0xFFFFFFFF
            for k in range(order):
                h = ((h ^ data[i + k]) * int(language._FACTORS[k])) & 0xFFFFFFFF
                h ^= h >> 15
            found.append(h % language.BUCKETS)
    n = max(1, len(found))
    z = [sum(float(model.table[c][h]) for h in found) / n + b for c, b in enumerate(model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    best, deviation = e.index(max(e)), 0.0
    if model.frequency is not None:
        centre, between, single = map(float, model.usual[best])
        deviation = (sum(float(model.frequency[best][h]) for h in found) / n - centre) / math.sqrt(between**2 + single**2 / n)
    return model.languages[best], max(e) / sum(e), deviation


def test_prediction_is_brute_force():
    r = language.np.random.default_rng(2)
    model = language.LanguageModel(("a", "b", "c"), r.normal(size=(3, language.BUCKETS)).astype("float32"), r.normal(size=3), 0.0)
    texts = [None, "", "½ 123", "² ① ৴", "one", "É È, ü!", "x" * 300, "日本語 text—with “quotes”", " a  b\n\tc ", "İstanbul ǅ", "99 bottles", MESSY[0][1]]
    for text in texts:
        expected = naive(model, text)
        assert model.predict(text) == (expected[0], pytest.approx(expected[1], abs=1e-5))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_trained_model_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    for r in docs.limit(40).collect():
        expected, got = naive(model, r.text), model.judge(r.text)
        assert got[0] == expected[0] and got[1] == pytest.approx(expected[1], abs=1e-4) and got[2] == pytest.approx(expected[2], abs=1e-2)


@pytest.mark.parametrize("text", ["½ 123", "² ① ৴", "١٢٣", "_ 1_2", "—…!", "", None])
def test_texts_without_a_letter(text):
    model = language.LanguageModel(("a",), language.np.zeros((1, language.BUCKETS), "float32"), language.np.zeros(1), 0.0)
    assert model.predict(text) == ("und", 0.0) and not model.accepts(model.judge(text))
