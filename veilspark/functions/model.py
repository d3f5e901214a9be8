"""The executable specification: spans of one line, merged and replaced, in plain Python.

Every rule is applied to every line. A rule's literal, if any, must occur in the line. Spans are code points, sorted by
start, longest first, then rule; overlapping spans merge under the first one's label; touching spans stay apart.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from veilspark.operators.rules import RuleSet


class Span(NamedTuple):
    start: int
    end: int
    rule_id: int


class Redaction(NamedTuple):
    """``hits`` counts matches before merging, ``spans`` are the merged ones."""

    redacted: str
    spans: list[Span]
    hits: int


def find_spans(rules: RuleSet, line: str, active: Iterable[int] | None = None) -> list[Span]:
    """All matches of all rules in one line, in no order; empty matches do not count."""
    out = []
    for i in range(len(rules)) if active is None else active:
        rule = rules.rules[i]
        if rule.literal and rule.literal not in line:
            continue
        out += [Span(m.start(), m.end(), i) for m in rule.pattern.finditer(line) if m.end() > m.start()]
    return out


def merge_spans(spans: list[Span]) -> list[Span]:
    """Sorted spans; each overlap is one span with the label of its first."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end, s.rule_id)):
        if out and s.start < out[-1].end:
            if s.end > out[-1].end:
                out[-1] = out[-1]._replace(end=s.end)
        else:
            out.append(s)
    return out


def replace_spans(line: str, spans: list[Span], tags: list[str]) -> str:
    """``line`` with merged spans replaced by their rules' tags."""
    parts, at = [], 0
    for s in spans:
        parts += (line[at : s.start], tags[s.rule_id])
        at = s.end
    return "".join((*parts, line[at:]))


def redact_line(rules: RuleSet, line: str, active: Iterable[int] | None = None) -> Redaction:
    found = find_spans(rules, line, active)
    if not found:
        return Redaction(line, [], 0)
    merged = merge_spans(found)
    return Redaction(replace_spans(line, merged, [r.tag for r in rules]), merged, len(found))


def redact_text(rules: RuleSet, text: str, active: Iterable[int] | None = None) -> tuple[str, list[tuple[int, Span]], int]:
    """Every line on its own, newlines kept: the text, (line number, span) pairs, and hits."""
    lines, spans, hits = [], [], 0
    for n, line in enumerate(text.split("\n")):
        r = redact_line(rules, line, active)
        lines.append(r.redacted)
        spans += [(n, s) for s in r.spans]
        hits += r.hits
    return "\n".join(lines), spans, hits
