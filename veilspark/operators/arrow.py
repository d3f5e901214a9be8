"""The Arrow path: whole batches are screened by vectorised kernels, only rows that may match reach Python.

A rule whose literal is telling screens by substring search, others by their RE2 form; a row that no rule can match is
returned as it came. Screening is lossless: it only ever keeps too much. Compiled rules are cached by each worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veilspark.functions.dialect import to_re2
from veilspark.functions.model import find_spans, redact_line
from veilspark.operators.cascade import Cascade
from veilspark.operators.rules import RuleSet

MODES = ("complete", "cascade")
ON_ERROR = ("raise", "null", "mask_all")
LONG_LINES = ("process", "null", "error")
MASK = "[REDACTED]"
#: Bytes of texts searched at once; larger batches are halved, so memory follows neither their rows nor the session's settings.
MOST_BYTES = 8 << 20
#: Literals beyond which the rows that have any are searched by an automaton.
MANY_LITERALS = 24

FINDING = "struct<rule_id:int,name:string,line_no:int,start:int,end:int,match:string>"
RESULT = f"struct<redacted:string,modified:boolean,n_spans:int,n_hits:int,findings:array<{FINDING}>>"
_FINDING = pa.struct([("rule_id", pa.int32()), ("name", pa.string()), ("line_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())])
_RESULT = pa.struct([("redacted", pa.string()), ("modified", pa.bool_()), ("n_spans", pa.int32()), ("n_hits", pa.int32()), ("findings", pa.list_(_FINDING))])


#: Lines of a text, by number, with the rules that may match there.
Marks = list[tuple[int, list[int]]]


@dataclass(frozen=True)
class Policy:
    """How values are treated: ``mode``, what an error gives, and what becomes of lines over ``max_line_bytes``."""

    mode: str = "complete"
    on_error: str = "raise"
    max_line_bytes: int | None = None
    long_lines: str = "process"

    def __post_init__(self) -> None:
        for value, known in ((self.mode, MODES), (self.on_error, ON_ERROR), (self.long_lines, LONG_LINES)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")


class Screen:
    """Which rows of a batch each rule may match.

    Rules are screened by their literal where it is telling, else by their regex. One pass of an alternation of all of
    them runs over every row; only rows that pass are looked at rule by rule.
    """

    #: Single characters rare enough in text to screen by.
    TELLING = frozenset("@;%#|~^")

    def __init__(self, rules: RuleSet) -> None:
        self.literals: dict[str, list[int]] = {}
        self.regexes: list[tuple[str, int]] = []
        self.always: list[int] = []
        for i, r in enumerate(rules):
            if len(r.literal) > 2 or r.literal in self.TELLING or len(r.literal) == 2 and not r.literal.isdigit():
                self.literals.setdefault(r.literal, []).append(i)
            elif _runs(to_re2(r.regex)):
                self.regexes.append((to_re2(r.regex), i))
            else:
                self.always.append(i)
        self.first = ["|".join([*(re.escape(x) for x in self.literals), *(f"(?:{x})" for x, _ in self.regexes)])]
        if not _runs(self.first[0]):  # too large together
            self.first = [re.escape(x) for x in self.literals] + [x for x, _ in self.regexes]
        self.automaton = _automaton(self.literals) if len(self.literals) > MANY_LITERALS else None

    @staticmethod
    def _where(texts: pa.Array, pattern: str, literal: bool = False) -> np.ndarray:
        match = pc.match_substring if literal else pc.match_substring_regex
        return np.flatnonzero(pc.fill_null(match(texts, pattern), False).to_numpy(zero_copy_only=False))

    def passing(self, texts: pa.Array) -> np.ndarray:
        """The rows in which anything screened for may stand."""
        if self.always:
            return np.arange(len(texts))
        if not self.literals and not self.regexes:
            return np.empty(0, np.int64)
        rows = [self._where(texts, x) for x in self.first]
        return rows[0] if len(rows) == 1 else np.unique(np.concatenate(rows))

    def __call__(self, texts: pa.Array) -> dict[int, list[int]]:
        """Rows that may match, with their rules in order."""
        rows = self.passing(texts)
        if not len(rows):
            return {}
        own = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
        found: list[list[int]] = [list(self.always) for _ in range(len(rows))]
        if self.automaton is not None:
            for ids, text in zip(found, own.to_pylist(), strict=True):
                if text is not None:
                    for hit in {x for _, x in self.automaton.iter(text)}:
                        ids.extend(hit)
        else:
            for x, ids in self.literals.items():
                for k in self._where(own, x, True).tolist():
                    found[k].extend(ids)
        for x, i in self.regexes:
            for k in self._where(own, x).tolist():
                found[k].append(i)
        return {k: sorted(ids) for k, ids in zip(rows.tolist(), found, strict=True) if ids}


def _automaton(literals: dict[str, list[int]]):  # noqa: ANN202
    """All literals at once, if the library is there."""
    try:
        import ahocorasick
    except ImportError:
        return None
    out = ahocorasick.Automaton()
    for x, ids in literals.items():
        out.add_word(x, tuple(ids))
    out.make_automaton()
    return out


def _runs(regex: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), regex)
    except pa.ArrowInvalid:
        return False
    return True


class Compiled:
    """A rule set with its screen, cascade and policy, ready for batches."""

    def __init__(self, rules: RuleSet, policy: Policy, per_line: bool) -> None:
        self.rules, self.policy, self.per_line = rules, policy, per_line
        self.tags = [r.tag for r in rules]
        self.finders = [(r.literal, r.pattern.finditer) for r in rules]
        self.screen = Screen(rules)
        self.cascade = Cascade(rules) if policy.mode == "cascade" else None

    def lines(self, text: str) -> list[str]:
        return text.split("\n") if self.per_line else [text]

    def _too_long(self, text: str) -> bool:
        limit = self.policy.max_line_bytes
        return limit is not None and self.policy.long_lines != "process" and any(len(x.encode("utf-8", "surrogatepass")) > limit for x in self.lines(text))

    def everywhere(self, text: str) -> Marks:
        """Marks of every rule on every line."""
        return [(n, list(range(len(self.rules)))) for n in range(len(self.lines(text)))]

    def result(self, text: str, marks: Marks) -> dict | None:
        """The full result of one value."""
        try:
            if self._too_long(text):
                if self.policy.long_lines == "error":
                    raise ValueError(f"a line of more than {self.policy.max_line_bytes} bytes")
                return None
            out, findings, hits = self.lines(text), [], 0
            for n, active in [(n, []) for n in range(len(out))] if self.cascade else marks:
                line = out[n]
                r = self.cascade.redact_line(line) if self.cascade else redact_line(self.rules, line, active)
                out[n] = r.redacted
                hits += r.hits
                findings += [{"rule_id": s.rule_id, "name": self.rules[s.rule_id].name, "line_no": n, "start": s.start, "end": s.end, "match": line[s.start : s.end]} for s in r.spans]
            redacted = "\n".join(out)
            return {"redacted": redacted, "modified": redacted != text, "n_spans": len(findings), "n_hits": hits, "findings": findings}
        except Exception:
            if self.policy.on_error == "raise":
                raise
            return None if self.policy.on_error == "null" else {"redacted": MASK, "modified": True, "n_spans": 0, "n_hits": 0, "findings": []}

    def redacted(self, text: str, marks: Marks) -> str | None:
        """The redacted text alone: the common case without building findings."""
        if self.cascade or self.policy.on_error != "raise" or self.policy.max_line_bytes is not None:
            r = self.result(text, marks)
            return None if r is None else r["redacted"]
        if not self.per_line or "\n" not in text:
            return self._line(text, marks[0][1])
        out = text.split("\n")
        for n, active in marks:
            out[n] = self._line(out[n], active)
        return "\n".join(out)

    def _line(self, line: str, active: list[int]) -> str:
        spans = []
        for i in active:
            literal, find = self.finders[i]
            if literal in line:
                for m in find(line):
                    start, end = m.span()
                    if end > start:
                        spans.append((start, -end, i))
        if not spans:
            return line
        spans.sort()
        parts, at, stop, tags = [], 0, 0, self.tags
        for start, end, i in spans:
            if start < stop:
                stop = max(stop, -end)
                continue
            if stop > at:
                at = stop
            parts += (line[at:start], tags[i])
            at, stop = start, -end
        return "".join((*parts, line[stop:]))

    def marked(self, texts: pa.Array) -> dict[int, Marks]:
        """Rows with the lines that rules may match, and these rules: lines are screened, not whole texts."""
        if not self.per_line or not pc.any(pc.match_substring(texts, "\n")).as_py():
            return {k: [(0, ids)] for k, ids in self.screen(texts).items()}
        lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = self.screen(lists.flatten())
        out: dict[int, Marks] = {}
        rows = np.searchsorted(bounds, np.fromiter(found, np.int64, len(found)), "right") - 1
        for k, (line, ids) in zip(rows.tolist(), found.items(), strict=True):
            out.setdefault(k, []).append((line - int(bounds[k]), ids))
        return out

    def rows(self, texts: pa.Array) -> dict[int, Marks]:
        everything = self.cascade is not None or self.policy.max_line_bytes is not None
        found = {} if self.cascade else self.marked(texts)
        return {k: found.get(k, []) for k in range(len(texts))} if everything else found

    def redact(self, texts: pa.Array) -> pa.Array:
        found = self.rows(texts)
        rows = sorted(found)
        if not rows:
            return texts
        mask = np.zeros(len(texts), bool)
        mask[rows] = True
        old = texts.filter(pa.array(mask)).to_pylist()
        new = [None if x is None else self.redacted(x, found[k]) for k, x in zip(rows, old, strict=True)]
        return pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))

    def changed(self, texts: pa.Array) -> pa.Array:
        """The redacted texts of the rows that change, null for all others: what need not go back is not sent."""
        found = self.rows(texts)
        mask = np.zeros(len(texts), bool)
        new = []
        if found:
            rows = sorted(found)
            for k, x in zip(rows, texts.take(pa.array(rows)).to_pylist(), strict=True):
                y = None if x is None else self.redacted(x, found[k])
                if y != x:
                    mask[k] = True
                    new.append(y)
        return pc.replace_with_mask(pa.nulls(len(texts), texts.type), pa.array(mask), pa.array(new, texts.type))

    def results(self, texts: pa.Array) -> pa.Array:
        found = self.rows(texts)
        out = []
        for k, text in enumerate(texts.to_pylist()):
            if text is None:
                out.append(None)
            elif k in found:
                out.append(self.result(text, found[k]))
            else:
                out.append({"redacted": text, "modified": False, "n_spans": 0, "n_hits": 0, "findings": []})
        return pa.array(out, _RESULT)

    def findings(self, texts: pa.Array) -> pa.Array:
        found = self.rows(texts)
        out: list[list[dict] | None] = [[] if v else None for v in texts.is_valid().to_pylist()]
        for k, marks in found.items():
            text = texts[k].as_py()
            if text is not None:
                r = self.result(text, marks)
                out[k] = None if r is None else r["findings"]
        return pa.array(out, pa.list_(_FINDING))

    def sensitive(self, texts: pa.Array) -> pa.Array:
        flags: list[bool | None] = [False if v else None for v in texts.is_valid().to_pylist()]
        for k, marks in self.rows(texts).items():
            text = texts[k].as_py()
            if text is None:
                continue
            lines = self.lines(text)
            if self.cascade:
                flags[k] = any(self.cascade.redact_line(x).spans for x in lines)
            else:
                flags[k] = any(find_spans(self.rules, lines[n], active) for n, active in marks)
        return pa.array(flags, pa.bool_())

    def redact_lists(self, lists: pa.Array) -> pa.Array:
        """Arrays of texts, redacted together, with their shape and nulls kept."""
        flat = self.redact(lists.flatten())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(lists) if lists.null_count else None)


_compiled: dict[tuple[str, Policy, bool], Compiled] = {}


def compiled(rules: RuleSet, policy: Policy, per_line: bool) -> Compiled:
    """The compiled rules, made once by each worker."""
    key = (rules.fingerprint(), policy, per_line)
    if key not in _compiled:
        if len(_compiled) > 16:
            _compiled.clear()
        _compiled[key] = Compiled(rules, policy, per_line)
    return _compiled[key]


def _udf(rules: RuleSet, policy: Policy, per_line: bool, kind: str, method: str) -> Callable[[Column | str], Column]:
    own = RuleSet(rules.rules)

    def run(texts: pa.Array) -> pa.Array:
        if texts.nbytes > MOST_BYTES and len(texts) > 1:
            half = len(texts) // 2
            return pa.concat_arrays([run(texts.slice(0, half)), run(texts.slice(half))])
        return getattr(compiled(own, policy, per_line), method)(texts)

    return arrow_udf(run, kind)


def redact_udf(rules: RuleSet, policy: Policy = Policy(), per_line: bool = True) -> Callable[[Column | str], Column]:
    """The redacted text. Unless the policy may null a text, only changed texts come back from Python."""
    if policy.on_error == "null" or policy.long_lines == "null":
        return _udf(rules, policy, per_line, "string", "redact")
    changed = _udf(rules, policy, per_line, "string", "changed")
    return lambda text: F.coalesce(changed(text), F.col(text) if isinstance(text, str) else text)


def whole_udf(rules: RuleSet, policy: Policy = Policy(), per_line: bool = True) -> Callable[[Column | str], Column]:
    """The redacted text as one function, as SQL needs it."""
    return _udf(rules, policy, per_line, "string", "redact")


def result_udf(rules: RuleSet, policy: Policy = Policy(), per_line: bool = True) -> Callable[[Column | str], Column]:
    return _udf(rules, policy, per_line, RESULT, "results")


def findings_udf(rules: RuleSet, policy: Policy = Policy(), per_line: bool = True) -> Callable[[Column | str], Column]:
    return _udf(rules, policy, per_line, f"array<{FINDING}>", "findings")


def sensitive_udf(rules: RuleSet, policy: Policy = Policy(), per_line: bool = True) -> Callable[[Column | str], Column]:
    return _udf(rules, policy, per_line, "boolean", "sensitive")


def redact_lists_udf(rules: RuleSet, policy: Policy = Policy(), per_line: bool = True) -> Callable[[Column | str], Column]:
    return _udf(rules, policy, per_line, "array<string>", "redact_lists")
