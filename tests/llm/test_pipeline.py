import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.conftest import MESSY
from tests.llm.test_language import naive
from tests.llm.test_mixing import fill
from tests.llm.test_near_duplicates import brute as brute_classes
from veilspark.llm import language, mixing, oracles, quality
from veilspark.llm.common import WORD
from veilspark.llm.queries import tokenizer_path


def test_stages(spark, messy, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicate_join", "source_mixing", "sentence_pieces"]
    for docs in (messy, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == messy.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_run_is_the_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    own = Counter((r.doc_id, r.ids_crc32) for r in docs.collect())
    assert own == Counter((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())


def test_quality_stage_is_the_verdict(spark, messy):
    kept = Counter(r.doc_id for r in corpus_pipeline.quality_rules(spark, messy, "").collect())
    assert kept == Counter(r[0] for r in MESSY if quality.judge(r[1]).kept)


def _quality(sf):
    """Ids that SQL keeps, and the text without the lines that fail."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.OP1_SQL}) WHERE kept").fetchall()}
    c = quality.QualityConfig()
    for i, text, lang, source, n in con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall():
        if i in kept:
            lines = [x for x in text.split("\n") if not WORD.search(x) or not quality.line_fails(WORD.findall(x), x, c)]
            yield i, "\n".join(lines), lang, source, len("\n".join(lines))


def _mixed(rows):
    """Water-filling by rounds, then whole and fractional repetitions in the order of the digests."""
    size = {k: len(WORD.findall(r[1])) for k, r in enumerate(rows)}
    total = defaultdict(int)
    for k, r in enumerate(rows):
        total[r[3]] += size[k]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = fill(total, {s: 1 + i % 3 for i, s in enumerate(order)})
    digest = {k: hashlib.md5(f"{mixing.SEED}:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest() for k, r in enumerate(rows)}
    for s in order:
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        passed = 0
        for k in sorted((k for k, r in enumerate(rows) if r[3] == s), key=digest.get):
            passed += size[k]
            more = passed - size[k] / 2 < target[s] - whole * total[s]
            yield from [rows[k]] * min(3, whole + more)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_run_is_brute_force(spark):
    """Every stage again in plain Python, one after the other."""
    sentencepiece = pytest.importorskip("sentencepiece")
    sf = "/root/testdata/sf0.001"
    rows = list(_quality(sf))
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    judged = [naive(model, r[1]) for r in rows]
    rows = [r for r, (lang, p, deviation) in zip(rows, judged, strict=True) if lang != "und" and p >= model.threshold and deviation >= model.least]
    best = {}
    for k, (members, _, _) in brute_classes(rows).items():
        key = (rows[k][0], np.int64(np.uint64(xxhash.xxh64_intdigest(rows[k][1].encode(), 42))))
        best[members] = min(best.get(members, (key, k)), (key, k))
    rows = [rows[k] for _, k in best.values()]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    expected = Counter((r[0], zlib.crc32(np.array(library.encode(r[1]), "<u4").tobytes())) for r in _mixed(rows))
    assert expected == Counter((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) and len(expected) > 50
