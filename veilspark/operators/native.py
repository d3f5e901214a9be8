"""The Catalyst path for small rule sets: chains of built-in regex functions, no Python.

A chain applies rules one after the other, so a later rule sees the tags of earlier ones; the merge of the Arrow path
does not. Rules with a literal are gated by ``contains`` on the original value: the gate picks the pattern, it does not
wrap the value, so the expression grows linearly with the rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.dialect import java_replacement, to_java
from veilspark.operators.rules import Rule, RuleSet

#: A pattern that never matches.
NEVER = "(?!)"


def _implied(rule: Rule) -> bool:
    """Whether every match holds the literal anyway, so that no gate is needed."""
    return not rule.literal or to_java(rule.regex).startswith(rule.literal) or rule.literal in ("@", ".") and f"{rule.literal}" in rule.regex


def pattern(rule: Rule, text: Column) -> Column:
    """The rule's Java pattern, or one that never matches where its literal is absent.

    Literals that every match holds are gated too unless nearly every text has them: finding that there is no ``@`` is
    cheaper than trying a pattern from every character.
    """
    own = F.lit(to_java(rule.regex))
    return own if rule.literal in ("", ".") and _implied(rule) else F.when(F.contains(text, F.lit(rule.literal)), own).otherwise(F.lit(NEVER))


def _gated(rule: Rule, text: Column, absent: Column, found: Column) -> Column:
    """``found``, or ``absent`` without a search where the rule's literal is not in the text; null for a null text."""
    if rule.literal in ("", "."):
        return found
    return F.when(~F.contains(text, F.lit(rule.literal)), absent).otherwise(found)


def redact_chain(text: Column | str, rules: Iterable[Rule]) -> Column:
    """``text`` with the matches of each rule in turn replaced by its tag."""
    col = F.col(text) if isinstance(text, str) else text
    return reduce(lambda c, r: F.regexp_replace(c, pattern(r, col), F.lit(java_replacement(r.tag))), rules, col)


def redact_lines_chain(text: Column | str, rules: Iterable[Rule]) -> Column:
    """The chain on every line of a text, so that no match crosses a line."""
    own = tuple(rules)
    return F.array_join(F.transform(split_lines(text), lambda line: redact_chain(line, own)), "\n")


def hit_count(text: Column | str, rule: Rule) -> Column:
    """Matches of one rule, as a long."""
    col = F.col(text) if isinstance(text, str) else text
    return _gated(rule, col, F.lit(0), F.regexp_count(col, F.lit(to_java(rule.regex)))).cast("long")


def matches(text: Column | str, rule: Rule) -> Column:
    """The matched strings of one rule."""
    col = F.col(text) if isinstance(text, str) else text
    return _gated(rule, col, F.array().cast("array<string>"), F.regexp_extract_all(col, F.lit(to_java(rule.regex)), F.lit(0)))


def has_match(text: Column | str, rules: Iterable[Rule]) -> Column:
    """Whether any rule matches."""
    col = F.col(text) if isinstance(text, str) else text
    return reduce(lambda a, b: a | b, (_gated(r, col, F.lit(False), F.regexp_like(col, F.lit(to_java(r.regex)))) for r in rules), F.lit(False))


def any_literal(text: Column | str, rules: RuleSet) -> Column:
    """The lossless gate: a rule's literal occurs, or a rule has none."""
    col = F.col(text) if isinstance(text, str) else text
    if any(not r.literal for r in rules):
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.contains(col, F.lit(x)) for x in dict.fromkeys(r.literal for r in rules)), F.lit(False))


def tag_count(text: Column | str) -> Column:
    """Tags of the default form in a text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(col, F.lit(r"\[REDACTED:")).cast("long")


def split_lines(text: Column | str) -> Column:
    """The lines of a text; only a newline ends one."""
    col = F.col(text) if isinstance(text, str) else text
    return F.split(col, "\n", -1)


def first_match(text: Column | str, rule: Rule) -> Column:
    """The place of the first match, from 1; 0 without one."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_instr(col, pattern(rule, col)).cast("long")
