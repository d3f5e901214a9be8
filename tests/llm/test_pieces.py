import random

import pyarrow as pa
import pytest

from tests.llm.conftest import LONG, MESSY, PROSE
from veilspark.llm import pieces
from veilspark.llm.queries import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")
FILE = tokenizer_path("piece_bpe_32k.model")


def texts():
    r = random.Random(1)
    alphabet = "aabbcdeth  \n\t日本é.,!0129<>x▁́😀ﬁ\x01 "
    return ["", PROSE, LONG[:20000], "a" * 3000, "  two  spaces ", *("".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(2000)), "".join(r.choice("abcdeth") for _ in range(9000))]


def test_ids_are_the_library_s():
    model, library = pieces.load(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    own = texts()
    got = model.encode(pa.array(own))
    assert [x.tolist() for x in got] == library.encode(own)
    assert [model.decode(x.tolist()) for x in got] == [x.replace("▁", " ") for x in own]


def test_stream_commits_in_a_window():
    model = pieces.load(FILE)
    text = "".join(random.Random(2).choice("abcdeth") for _ in range(5000))
    runs = list(model.viterbi(iter(text)))
    assert len(runs) > 20
    assert max(map(len, runs)) <= model.longest + pieces.COMMIT_EVERY and b"".join(model.bytes[x] for r in runs for x in r).decode() == text
    whole = [x for r in model.viterbi("▁" + text) for x in r]
    assert whole == sentencepiece.SentencePieceProcessor(model_file=FILE).encode(text)


def test_what_is_remembered_is_bounded():
    kept = pieces.Remembered(1000)
    for i in range(100):
        kept.put(i, i, 300)
        assert len(kept) <= 3 and kept.held <= 1000 and kept[i] == i


def test_small_caches_change_nothing(monkeypatch):
    own = texts()[:300]
    for name in ("UNIT_BYTES", "PREFIX_BYTES", "PAIR_BYTES", "SPLIT_BYTES"):
        monkeypatch.setattr(pieces, name, 3000)
    small, library = pieces.PieceModel(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert [x.tolist() for x in small.encode(pa.array(own))] == library.encode(own)


def test_table(spark, messy, none):
    got = pieces.encode_documents(messy, FILE).collect()
    assert len(got) == len(MESSY) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert pieces.encode_documents(none, FILE).count() == 0
