"""Quality rules: line-first cleaning.

Every line of a text is judged on its own by three families of rules: punctuation (signs for words, shouting, upper
case, no sentence's end), navigation (separators, menus of titles), boilerplate (phrases, repetition). Failing lines are
removed; a document that loses too much of its text, or that fails the document rules, is rejected.

Defined results: a null text has no words and is rejected; an empty text likewise; a line without a word never fails
and is never counted; repeated rows are judged alike, each on its own; extra columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspark.llm.common import WORD, bound_batches, in_slices, map_rows

SYMBOLS = re.compile(r"[#*$%&|<>]")
SEPARATORS = frozenset(("|", "»", "«", "›", "‹", "·", "•", "::", "/", "-", "–", "—", ">", "<"))
#: A sentence's end at the end of a line, with closing signs; one anywhere; a word of a menu; what a menu does not hold.
LINE_END, SENTENCE, TITLED, INNER = re.compile(r"[.!?:;…][\"'”’»)\]]*\s*$"), re.compile(r"[.!?…]"), re.compile(r"[A-Z]"), re.compile(r"[.!?;:,]")
SHOUT_END = re.compile(r"(?:!!|\?\?|!\?|\?!)\S*$")
#: Fixed phrases of page furniture.
BOILERPLATE = re.compile(
    r"all rights reserved|cookie (?:policy|settings|consent)|privacy policy|terms (?:of use|of service|and conditions)"
    r"|enable javascript|javascript is disabled|click here|read more|sign (?:in|up)\b|log ?in\b|subscribe (?:now|to our)"
    r"|share (?:this|on)\b|follow us|back to top|skip to (?:main )?content|powered by\b|lorem ipsum|add to cart",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class QualityConfig:
    """Limits of the rules; the defaults are the production parameters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line fails when it has more symbols than this share of its words.
    max_symbols_per_word: float = 0.5
    #: A line fails when more than this share of its words end in doubled exclamation or question marks.
    max_shout_share: float = 0.3
    #: A line of at least ``upper_min_words`` words fails when more than this share of them is upper case.
    max_upper_share: float = 0.7
    upper_min_words: int = 5
    #: A line of at least so many words fails when it holds no sentence's end and does not end in a sign.
    open_min_words: int = 8
    #: A line of at least so many words, this share of them with a capital first and no sign among them, fails as a menu.
    menu_min_words: int = 5
    min_menu_share: float = 0.9
    #: A line fails as navigation with at least this share of separator tokens.
    min_separator_share: float = 0.2
    #: A line of at least ``repeat_min_words`` words fails when fewer than this share of them are distinct.
    repeat_min_words: int = 20
    min_distinct_share: float = 0.25
    #: A boilerplate phrase fails a line of at most so many words.
    boilerplate_max_words: int = 15
    #: A document is rejected when it loses more than this share of its words.
    max_lost_share: float = 0.5


def line_fails(words: list[str], line: str, c: QualityConfig) -> str | None:
    """The family of the first rule that a line with words fails, or None."""
    n = len(words)
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and separators >= c.min_separator_share * n:
        return "navigation"
    if len(SYMBOLS.findall(line)) > c.max_symbols_per_word * n:
        return "punctuation"
    if ("!!" in line or "?" in line or "!?" in line) and sum(bool(SHOUT_END.search(w)) for w in words) > c.max_shout_share * n:
        return "punctuation"
    if n >= c.upper_min_words and line.lower() != line and sum(w.upper() == w and w.lower() != w for w in words) > c.max_upper_share * n:
        return "punctuation"
    if n >= c.menu_min_words and not INNER.search(line) and sum(bool(TITLED.match(w)) for w in words) >= c.min_menu_share * n:
        return "navigation"
    if n >= c.repeat_min_words and len(set(words)) < c.min_distinct_share * n:
        return "boilerplate"
    if n <= c.boilerplate_max_words and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= c.open_min_words and not SENTENCE.search(line) and not LINE_END.search(line):
        return "punctuation"
    return None


def repeat_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found at least twice in the text, the first place included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


@dataclass(frozen=True)
class Verdict:
    """What the rules say of one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_failed_lines: int
    kept_words: int
    base_failed: bool
    kept: bool
    text: str | None


def judge(text: str | None, c: QualityConfig = QualityConfig()) -> Verdict:
    """Apply the line rules, then the document rules, to one whole text."""
    if text is None:
        return Verdict(0, 0, 0, 0, 0, 0, 0, 0, True, False, None)
    words: list[str] = []
    kept_lines: list[str] = []
    seen: set[str] = set()
    duplicates = failed = kept_words = lines = 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        lines += 1
        words += own
        repeated = line in seen
        if repeated:
            duplicates += 1
        else:
            seen.add(line)
        if line_fails(own, line, c):
            failed += 1
        else:
            kept_words += len(own)
            kept_lines.append(line)
    n, repeats = len(words), repeat_words(words)
    base_failed = n < c.min_words or 100 * repeats > c.max_repeat_percent * n
    return Verdict(
        n, sum(map(len, words)), len(SYMBOLS.findall(text)), duplicates, repeats, lines, failed, kept_words,
        base_failed, not base_failed and n - kept_words <= c.max_lost_share * n, "\n".join(kept_lines),
    )


VERDICT_FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("n_lines", T.LongType()), T.StructField("n_failed_lines", T.LongType()),
    T.StructField("kept_words", T.LongType()),
]


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per row of ``docs``: its id and the figures and verdict of the rules. Reads only the two columns."""
    bound_batches(docs.sparkSession)
    src = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(x.as_py(), config) for x in b.column(1)]
            columns = [b.column(0)]
            for f in VERDICT_FIELDS:
                columns.append(pa.array([getattr(v, f.name) for v in found], pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, *(f.name for f in VERDICT_FIELDS)])

    return src.mapInArrow(in_slices(run, 1), T.StructType([src.schema[id_col], *VERDICT_FIELDS]))


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that stay, failing lines removed from ``text_col``; every column of ``docs`` is returned.

    ``length_col``, if present, is set to the code points of the cleaned text.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(x.as_py(), config) for x in b.column(at)]
            stay = pa.array([i for i, v in enumerate(found) if v.kept], pa.int64())
            out = b.take(stay)
            texts = [v.text for v in found if v.kept]
            columns = list(out.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if length_at is not None:
                columns[length_at] = pa.array([len(x) for x in texts], pa.int64()).cast(columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_rows(docs, run, at)
