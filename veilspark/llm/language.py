"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed subwords (runs of 2 to 4 bytes of its lower-cased letters, words set
apart by spaces); a linear softmax on the mean gives the languages' probabilities. Both are trained by stochastic
gradient descent in numpy on the driver, on a sample bounded by ``PER_LANGUAGE`` documents of each of the
``MOST_LANGUAGES`` most frequent languages; only hashed
counts of the sample leave the executors. As the model is linear in the mean, prediction looks up one number per subword
and language, over whole texts.

Two things are calibrated on a part of the sample that training has not seen. A temperature makes the probabilities
honest among the learned languages. They say nothing of other texts, so a second number does: the mean log-frequency of
a text's subwords in the language predicted, as a deviation from what texts of that language and length have. A text is
accepted when its probability and its deviation are within limits that nearly all of the calibration part keeps, with a
margin for clean texts that are shorter or odder than those seen; program code and languages not learned are far beyond.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and not accepted; with no labelled row
every text is ``und``; rows with null text or label are never learned from; repeated rows are predicted alike; other
columns pass through ``keep_known`` untouched and are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import bound_batches, in_slices, map_rows

#: Documented bounds of the training sample: documents of each language, and languages, those with most documents.
PER_LANGUAGE, MOST_LANGUAGES = 500, 200
BUCKETS, DIMENSION = 1 << 15, 16
ORDERS = (2, 3, 4)
EPOCHS, BATCH, RATE, SEED = 10, 16, 0.5, 7
#: Share of the sample kept for calibration, the share of it that the limit on the probability may reject, and the quantile
#: of the deviation with the factor by which the limit is beyond it.
CALIBRATION, REJECTED, TAIL, MARGIN = 0.2, 0.001, 0.01, 3.0
#: Weight of the even distribution in the frequencies of subwords.
EVEN = 0.02
UNKNOWN = "und"
#: Runs of word characters that are no ASCII digit; only these hold letters, and other signs too (fractions, digits of other scripts).
MAY_HOLD_LETTERS = re.compile(r"[^\W0-9_]+")
#: Characters beyond ASCII that stand for a space: all but word characters and marks.
NO_LETTERS = re.compile("[^\\w\x00-\x7f\u0300-\u036f\u0900-\u0dff\u0e30-\u0e4e]+")
#: Bytes hashed at once; bounds the temporary arrays.
CHUNK = 1 << 20

# Bytes that are no ASCII letter and no part of a longer character stand for a space.
_KEEP = np.zeros(256, np.uint8) + 32
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a text holds a letter (Unicode categories L*)."""
    return any(any(map(str.isalpha, m[0])) for m in MAY_HOLD_LETTERS.finditer(text))


def letters(text: str) -> np.ndarray:
    """The lower-cased letters of a text as bytes; every other run is one space, one more at either end.

    Beyond ASCII all that Python takes for a word's character is kept, and marks, which belong to letters.
    """
    low = text.lower()
    if not low.isascii():
        low = NO_LETTERS.sub(" ", low)
    raw = _KEEP[np.frombuffer(f" {low} ".encode("utf-8", "replace"), np.uint8)]
    blank = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return raw[keep]


def subwords(data: np.ndarray, order: int) -> np.ndarray:
    """Buckets of all runs of ``order`` bytes."""
    n = len(data) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, 0x811C9DC5 + order, np.uint32)
    for k in range(order):
        h = (h ^ data[k : k + n]) * _FACTORS[k]
        h ^= h >> np.uint32(15)
    return (h % np.uint32(BUCKETS)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a whole text, their shares, and the number of its subwords."""
    data = letters(text)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK + max(ORDERS) - 1]
        for k in ORDERS:
            counts += np.bincount(subwords(piece[: CHUNK + k - 1], k), minlength=BUCKETS)
    where = np.flatnonzero(counts)
    n = int(counts.sum())
    return where, counts[where] / max(1, n), n


@dataclass(frozen=True)
class LanguageModel:
    """What prediction needs.

    ``languages``; a score of every bucket and the bias, both divided by the temperature; the least probability that is
    accepted; for each language log-frequencies of the buckets, and mean, deviation between texts and deviation of a
    single subword; the least deviation that is accepted.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    threshold: float
    frequency: np.ndarray | None = None
    usual: np.ndarray | None = None
    least: float = -np.inf

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, probability and deviation."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, -np.inf
        data, total, n = letters(text), np.zeros(len(self.languages)), 0
        pieces = []
        for at in range(0, len(data), CHUNK):
            piece = data[at : at + CHUNK + max(ORDERS) - 1]
            for k in ORDERS:
                h = subwords(piece[: CHUNK + k - 1], k)
                n += len(h)
                # Two float columns fit one gather better than a matrix row each.
                total += [float(self.table[c].take(h).sum(dtype=np.float64)) for c in range(len(self.languages))]
                pieces.append(h.astype(np.uint16 if BUCKETS <= 1 << 16 else np.uint32))
        p = _softmax((total / max(1, n) + self.bias)[None])[0]
        best = int(p.argmax())
        deviation = 0.0
        if self.frequency is not None:
            logs = sum(float(self.frequency[best].take(h).sum(dtype=np.float64)) for h in pieces)
            deviation = float(_deviation(logs / max(1, n), n, self.usual[best]))
        return self.languages[best], float(min(1.0, max(0.0, p[best]))), deviation

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def accepts(self, judged: tuple[str, float, float]) -> bool:
        """Whether a text is in the language predicted."""
        return judged[0] != UNKNOWN and judged[1] >= self.threshold and judged[2] >= self.least


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _deviation(mean: np.ndarray | float, n: np.ndarray | int, usual: np.ndarray) -> np.ndarray | float:
    """How far a mean over ``n`` subwords is from the usual one, by the deviation of texts of that length."""
    return (mean - usual[..., 0]) / np.sqrt(usual[..., 1] ** 2 + usual[..., 2] ** 2 / np.maximum(1, n))


def train(rows: list[tuple[str, np.ndarray, np.ndarray, int]]) -> LanguageModel:
    """SGD on ``(language, buckets, shares, subwords)`` of the sample, in the order given."""
    languages = tuple(sorted({x[0] for x in rows}))
    if not languages:
        return LanguageModel((), np.zeros((0, BUCKETS), np.float32), np.zeros(0), 0.0)
    rng = np.random.default_rng(SEED)
    y = np.array([languages.index(x[0]) for x in rows])
    order = rng.permutation(len(rows))
    held = max(1, int(CALIBRATION * len(rows))) if len(rows) > 4 else 0
    test, own = order[:held], order[held:]
    embedding = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    weights, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    steps, step = max(1, EPOCHS * -(-len(own) // BATCH)), 0
    for _ in range(EPOCHS):
        own = rng.permutation(own)
        for i in range(0, len(own), BATCH):
            batch, rate = own[i : i + BATCH], RATE * (1 - step / steps)
            step += 1
            mean = np.stack([rows[j][2] @ embedding[rows[j][1]] for j in batch])
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            back = error @ weights.T
            weights -= rate * mean.T @ error
            bias -= rate / len(batch) * error.sum(axis=0)
            # A mean spreads a step over its subwords; the factor brings it back to the scale of one subword.
            for g, j in zip(back, batch, strict=True):
                embedding[rows[j][1]] -= rate * 32 * np.outer(rows[j][2], g)
    table = embedding @ weights
    if not held:
        return LanguageModel(languages, np.ascontiguousarray(table.T, np.float32), bias, 0.0)
    logits = np.stack([rows[j][2] @ table[rows[j][1]] for j in test]) + bias
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.25, 8, 41):
        loss = -np.log(_softmax(logits / t)[np.arange(held), y[test]] + 1e-12).mean()
        if loss < best:
            best, temperature = loss, t
    p = _softmax(logits / temperature)
    # Half of the quantile: clean texts that are shorter than those seen stay above it.
    threshold = 0.5 * float(np.quantile(p.max(axis=1), REJECTED))
    threshold = min(0.5, max(threshold, 1.0 / len(languages) if len(languages) > 1 else 0.0))
    frequency = np.zeros((len(languages), BUCKETS))
    for j in own:
        frequency[y[j], rows[j][1]] += rows[j][2]
    frequency /= np.maximum(frequency.sum(axis=1, keepdims=True), 1e-300)
    logs = np.log((1 - EVEN) * frequency + EVEN / BUCKETS)
    # Of a single subword: the deviation of the logarithm under the language's own frequencies. Between texts: what the
    # calibration part has beyond that.
    means, usual = np.array([rows[j][2] @ logs[k][rows[j][1]] for j, k in zip(test, p.argmax(axis=1), strict=True)]), np.zeros((len(languages), 3))
    n = np.array([rows[j][3] for j in test])
    for k in range(len(languages)):
        centre = float((frequency[k] * logs[k]).sum())
        single = float(np.sqrt(max(1e-6, (frequency[k] * (logs[k] - centre) ** 2).sum())))
        mine = p.argmax(axis=1) == k
        spread = means[mine] if mine.sum() > 1 else means
        usual[k] = float(np.median(spread)), max(0.05, float(np.std(spread))), single
    deviations = _deviation(means, n, usual[p.argmax(axis=1)])
    least = MARGIN * min(-3.0, float(np.quantile(deviations, TAIL)))
    return LanguageModel(languages, np.ascontiguousarray(table.T / temperature, np.float32), bias / temperature, threshold, np.ascontiguousarray(logs, np.float32), usual, least)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Train on at most ``per_language`` documents of each language: those whose seeded hash of the id is least."""
    spark = docs.sparkSession
    bound_batches(spark)
    order = F.xxhash64(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.select(F.col(lang_col).alias("lang"), order.alias("order"), F.col(text_col).alias("text"))
    # A label column may hold anything: only the most frequent labels are languages to learn.
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in most.collect()}
    if not counts:
        return train([])
    # A first thinning by the hash, so that only about the bound of each language is ordered.
    share = F.coalesce(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * per_language / n + 50 / n))))[F.col("lang")], F.lit(0.0))
    thinned = labelled.where(F.pmod("order", F.lit(1 << 20)) < share * (1 << 20))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 20)), "order", "text"))
    sample = thinned.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in found], pa.list_(pa.float32())), pa.array([x[2] for x in found], pa.int64())],
                ["lang", "rank", "buckets", "shares", "n"],
            )

    found = sample.mapInArrow(in_slices(run, 2), "lang string, rank int, buckets array<int>, shares array<float>, n long").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    rows = [(a.as_py(), b.values.to_numpy().astype(np.int64), c.values.to_numpy().astype(np.float64), n.as_py()) for a, b, c, n in zip(found["lang"], found["buckets"], found["shares"], found["n"], strict=True)]
    return train([x for x in rows if len(x[1])])


def predict_documents(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, held_out, lang_pred, score, accepted."""
    bound_batches(docs.sparkSession)
    src = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    schema = T.StructType([src.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.judge(x.as_py()) for x in b.column(2)]
            accepted = list(map(model.accepts, found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(accepted, pa.bool_())], schema.names)

    return src.mapInArrow(in_slices(run, 2), schema)


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model accepts, all columns unchanged."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.accepts(model.judge(x.as_py())) for x in b.column(at)], pa.bool_()))

    return map_rows(docs, run, at)
