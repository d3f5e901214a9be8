"""Rules and rule sets: parsing, checking, union, lookup."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from veilspark.functions.dialect import extract_literal, to_python


@dataclass(frozen=True)
class Rule:
    """``literal`` (if not empty) must occur in a line for ``regex`` to be tried there."""

    name: str
    literal: str
    regex: str
    replacement: str = ""
    category: str = "custom"
    profile: str = ""
    source: str = ""
    line: int = 0

    @property
    def tag(self) -> str:
        return self.replacement or f"[REDACTED:{self.name}]"

    @property
    def pattern(self) -> re.Pattern[str]:
        return to_python(self.regex)


@dataclass(frozen=True)
class Reject:
    """A line of a rule file that is no rule."""

    source: str
    line: int
    text: str
    reason: str


@dataclass(frozen=True)
class Lint:
    rule: str
    kind: str
    message: str


def _compiles(regex: str) -> bool:
    try:
        to_python(regex)
    except (re.error, OverflowError):
        return False
    return True


def parse_rule(text: str, source: str = "", line: int = 0, category: str = "custom", unescape: bool = False) -> Rule | Reject | None:
    """One line of a rule file: name, literal, regex, replacement, divided by ``|``; None for blanks and comments.

    The first two fields and, with four or more, the last are taken from the ends; what is between is the regex, which
    may hold ``|``. Three fields have no replacement. If the regex alone does not compile but does so with the last
    field, the last field belongs to it.
    """
    stripped = text.strip("\r\n").lstrip()
    if not stripped.strip() or stripped.startswith("#"):
        return None
    parts = stripped.split("|")
    if len(parts) < 3:
        return Reject(source, line, text, "fewer than three fields")
    name, literal = parts[0].strip(), parts[1]
    regex, replacement = ("|".join(parts[2:-1]), parts[-1].strip()) if len(parts) > 3 else (parts[2], "")
    if not name:
        return Reject(source, line, text, "no name")
    if unescape:
        regex = regex.replace("\\\\", "\\")
    if len(parts) > 3 and not _compiles(regex) and _compiles(f"{regex}|{parts[-1]}"):
        regex, replacement = f"{regex}|{parts[-1]}", ""
    if not regex or not _compiles(regex):
        return Reject(source, line, text, "the regex does not compile" if regex else "no regex")
    return Rule(name, literal, regex, replacement, category, "", source, line)


def _check_path(path: str | os.PathLike[str], root: str | os.PathLike[str] | None) -> Path:
    p = Path(path)
    if ".." in p.parts:
        raise ValueError(f"{path}: '..' in a rule path")
    if root is not None and not p.resolve().is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path}: outside {root}")
    return p


_NESTED = re.compile(r"\([^()]*[+*][^()]*\)[+*]|\([^()]*[+*]\)\{\d+,\}")
_BROAD = re.compile(r"^(?:\[[^\]]+\]|\.|\\[wdsSWD])(?:\{\d+,?\d*\}|[+*])(?:\\b)?$")


@dataclass(frozen=True)
class RuleSet:
    """An ordered, immutable set of rules; the place of a rule is its id."""

    rules: tuple[Rule, ...] = ()
    rejects: tuple[Reject, ...] = field(default=(), compare=False)

    def __len__(self) -> int:
        return len(self.rules)

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def __getitem__(self, rule_id: int) -> Rule:
        return self.rules[rule_id]

    @staticmethod
    def of(rules: Iterable[Rule]) -> RuleSet:
        return RuleSet(tuple(rules))

    @staticmethod
    def builtin() -> RuleSet:
        """The 14 built-in rules."""
        from veilspark.operators.builtin import BUILTIN

        return RuleSet(BUILTIN)

    @staticmethod
    def profiles(*names: str) -> RuleSet:
        """Compliance profiles: hipaa, pci, gdpr, soc2, all."""
        from veilspark.operators.builtin import PROFILES

        wanted = [x for name in names for x in ([*PROFILES] if name == "all" else [name])]
        if unknown := [x for x in wanted if x not in PROFILES]:
            raise ValueError(f"unknown profile: {', '.join(unknown)}")
        return RuleSet(tuple(r for x in dict.fromkeys(wanted) for r in PROFILES[x]))

    @staticmethod
    def categories(*names: str) -> RuleSet:
        """Rules of the vendor catalog by category; all categories without names."""
        from veilspark.operators.builtin import catalog

        found = catalog()
        if unknown := [x for x in names if x not in {r.category for r in found}]:
            raise ValueError(f"unknown category: {', '.join(unknown)}")
        return RuleSet(tuple(r for r in found if not names or r.category in names))

    @staticmethod
    def from_lines(lines: Iterable[str], source: str = "", category: str = "custom", unescape: bool = False) -> RuleSet:
        found = [parse_rule(x, source, i, category, unescape) for i, x in enumerate(lines, 1)]
        return RuleSet(tuple(x for x in found if isinstance(x, Rule)), tuple(x for x in found if isinstance(x, Reject)))

    @staticmethod
    def from_file(path: str | os.PathLike[str], root: str | os.PathLike[str] | None = None, unescape: bool = False) -> RuleSet:
        p = _check_path(path, root)
        return RuleSet.from_lines(p.read_text("utf-8").split("\n"), str(path), p.stem, unescape)

    @staticmethod
    def from_dir(path: str | os.PathLike[str], recursive: bool = False, root: str | os.PathLike[str] | None = None, unescape: bool = False) -> RuleSet:
        """All ``*.txt`` of a folder in the order of their names; names that begin with a dot are skipped."""
        p = _check_path(path, root)
        files = sorted(x for x in (p.rglob if recursive else p.glob)("*.txt") if x.is_file() and not x.name.startswith("."))
        out = RuleSet()
        for x in files:
            out = out.union(RuleSet.from_file(x, unescape=unescape))
        return out

    @staticmethod
    def from_table(df: DataFrame) -> RuleSet:
        """Rules of a catalog table (name, literal, regex, replacement and, if there, category and profile)."""
        rows = df.select(*[c for c in ("name", "literal", "regex", "replacement", "category", "profile") if c in df.columns])
        order = [c for c in ("rule_id", "name") if c in df.columns]
        return RuleSet.of(Rule(**{k: v or "" for k, v in r.asDict().items()}) for r in (df.orderBy(*order).select(*rows.columns) if order else rows).collect())

    def union(self, other: RuleSet) -> RuleSet:
        """Both sets' rules in order; a rule that is equal in all but its origin stands once."""
        seen, out = set(), []
        for r in (*self.rules, *other.rules):
            key = (r.name, r.literal, r.regex, r.tag)
            if key not in seen:
                seen.add(key)
                out.append(r)
        return RuleSet(tuple(out), (*self.rejects, *other.rejects))

    def fingerprint(self) -> str:
        """A digest of what the rules do."""
        text = "\n".join(f"{r.name}\0{r.literal}\0{r.regex}\0{r.tag}" for r in self.rules)
        return hashlib.sha256(text.encode()).hexdigest()

    def lint(self) -> list[Lint]:
        """Warnings: doubled backslashes, nested repetition, very broad rules, repeated names, no literal."""
        out = []
        names = Counter(r.name for r in self.rules)
        for r in self.rules:
            if "\\\\" in r.regex:
                out.append(Lint(r.name, "doubled_backslash", "a doubled backslash matches a backslash"))
            if _NESTED.search(r.regex):
                out.append(Lint(r.name, "nested_repetition", "repetition inside repetition can take exponential time"))
            if _BROAD.match(r.regex):
                out.append(Lint(r.name, "broad", "the rule matches almost any text"))
            if names[r.name] > 1:
                out.append(Lint(r.name, "repeated_name", f"{names[r.name]} rules have this name"))
            if not r.literal and (found := extract_literal(r.regex)):
                out.append(Lint(r.name, "no_literal", f"{found!r} could be its literal"))
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The catalog table."""
        schema = "rule_id int, name string, literal string, regex string, replacement string, category string, profile string, source string, line int"
        return spark.createDataFrame([(i, r.name, r.literal, r.regex, r.tag, r.category, r.profile, r.source, r.line) for i, r in enumerate(self.rules)], schema)
