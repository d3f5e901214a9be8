import random
from collections import Counter

import pytest

from tests.llm.conftest import LONG, MESSY, PROSE
from veilspark.llm import quality
from veilspark.llm.common import WORD


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), failed


def test_base_is_brute_force():
    r = random.Random(1)
    texts = [None, "", PROSE, LONG] + ["".join(r.choice(["a", "b", "cd", " ", "\n", "#", "|", "\x0b", " ", "é"]) for _ in range(r.randint(0, 300))) for _ in range(400)]
    for t in texts:
        v = quality.judge(t)
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == brute(t)
        assert not (v.base_failed and v.kept)


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("An ordinary line of text ends here.", None), ("Home | About | Contact | Help", "navigation"), ("word### other%%% third$$$", "punctuation"),
        ("BUY NOW!! CHEAP!! HURRY!!", "punctuation"), ("LOUD WORDS ONLY IN THIS LINE", "punctuation"), ("All rights reserved.", "boilerplate"), ("go " * 30, "boilerplate"),
        ("LOUD Words MOSTLY IN THIS LINE HERE.", "punctuation"), ("LOUD words here and THERE, not more.", None), ("Home About Contact Help Login", "navigation"), ("Home About Contact Help, Team", None), ("Three Titled Words", None),
        ("a line that runs on and on with no end", "punctuation"), ("a line that runs on and on to its end:", None), ("Is it the end? said somebody who was still there", None), ("a heading of seven words stands here", None), ("he said “it is over and done with now.”", None),
    ],
)
def test_line_rules(line, family):
    assert quality.line_fails(WORD.findall(line), line, quality.QualityConfig()) == family


def test_document_loses_too_much():
    menu = "\n".join("Home | About | Contact | Help" for _ in range(1)) + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(30))
    assert not quality.judge(f"{PROSE}\n{menu}").kept
    mild = quality.judge(f"{PROSE}\nHome | About | Contact")
    assert mild.kept and mild.text == PROSE


def test_table(spark, messy, none):
    got = quality.assess(messy).collect()
    assert len(got) == len(MESSY) and {r.doc_id for r in got if r.kept} == {1, 5, 6, 10, None}
    cleaned = quality.clean(messy)
    assert cleaned.columns == messy.columns and cleaned.count() == 6
    assert all(r.n_chars == len(r.text) and r["a.b"] == "dot" for r in cleaned.collect())
    assert quality.assess(none).count() == quality.clean(none).count() == 0
