import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import LONG, MESSY, PROSE
from veilspark.llm import token_io
from veilspark.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
FILE = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["small", "outliers", "constant", "full", "one", "none"])
def test_shards_give_back_what_they_hold(kind):
    r = np.random.default_rng(3)
    n = {"one": 1, "none": 0}.get(kind, 9001)
    ids = {"small": r.integers(0, 49408, n), "outliers": np.where(r.random(n) < 0.02, r.integers(0, 2**32, n), r.integers(5, 60, n)), "constant": np.full(n, 7), "full": r.integers(0, 2**32, n)}.get(kind, np.arange(n)).astype(np.uint32)
    lengths = np.array([n // 3, 0, n - n // 3], np.uint32)
    payload = token_io.encode_shard(ids, lengths)
    assert (token_io.read_ids(payload) == ids).all() and (token_io.read_lengths(payload) == lengths).all()
    for first, count in ((0, min(n, 5)), (n // 2, n - n // 2), (n, 0)):
        assert (token_io.read_ids(payload, first, count) == ids[first : first + count]).all()
    with pytest.raises(ValueError):
        token_io.read_ids(payload, 0, n + 1)


def test_outliers_are_exceptions():
    ids = np.arange(2048, dtype=np.uint32) % 16
    ids[5] = 4_000_000_000
    assert len(token_io.encode_block(ids)) < 2048 * 4 // 8 + 9 + 7


def test_ids_are_the_library_s():
    r = random.Random(1)
    parts = list("aabBéÉßÿ  \n\t.,!?|$#'’sStT012²½ΣσİıḰ̸<=|>\x1c  日本中😀ªºµ×÷") + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "can't "]
    texts = ["", PROSE, LONG[:20000], *("".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000))]
    encoder, library = token_io.ChunkEncoder(FILE), tokenizers.Tokenizer.from_file(FILE)
    assert [x.tolist() for x in encoder(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files(spark, messy, none, monkeypatch):
    monkeypatch.setattr(token_io, "SHARD_IDS", 100)
    got = token_io.token_file_documents(messy, FILE).collect()
    library = tokenizers.Tokenizer.from_file(FILE)
    start = 0
    rows = sorted(((r[0], r[1] or "") for r in MESSY), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for have, (i, text) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (have.doc_id, have.start, have.n_tokens, have.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_io.token_file_documents(none, FILE).count() == 0
