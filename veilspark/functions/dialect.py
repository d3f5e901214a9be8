"""One regex, three engines: rules are written with ASCII classes and are rewritten for Java, Python and RE2.

In rules ``\\b``, ``\\w``, ``\\d`` and ``\\s`` mean ASCII. Java's ``\\b`` treats accented letters as word characters, so it
becomes lookarounds; Python gets ``re.ASCII``; RE2 is ASCII already.
"""

from __future__ import annotations

import re
from functools import lru_cache

_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_INNER = "(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\s", "xdigit": "0-9A-Fa-f", "word": r"\w"}


def _scan(regex: str) -> list[tuple[str, bool]]:
    """Tokens (an escape, a POSIX class or one character) and whether each stands inside a bracket class."""
    out, i, inside, first = [], 0, False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\" and i + 1 < len(regex):
            out.append((regex[i : i + 2], inside))
            i += 2
            continue
        if inside and (m := re.match(r"\[:(\w+):\]", regex[i:])) and m[1] in _POSIX:
            out.append((_POSIX[m[1]], True))
            i += m.end()
            continue
        if not inside and c == "[":
            inside, first = True, i + (2 if regex[i + 1 : i + 2] == "^" else 1)
            out.append((c, False))
        elif inside and c == "]" and i > first - 1 and i != first:
            inside = False
            out.append((c, False))
        else:
            out.append((c, inside))
        i += 1
    return out


#: A class of word characters alone, at the start or (with a count that is not zero) at the end of what is left.
_WORDS = r"\[(?:[0-9A-Za-z_](?:-[0-9A-Za-z])?)+\]"
_BEFORE, _AFTER = re.compile(_WORDS + r"(?![*?]|\{0)"), re.compile(r"(?<!\\)" + _WORDS + r"(?:\+|\{[1-9][0-9,]*\})?\Z")


@lru_cache(4096)
def to_java(regex: str) -> str:
    """The rule for ``regexp_*`` functions: ASCII word edges, ``[`` and ``&&`` inside a class taken as characters.

    An edge beside word characters looks only at its other side.
    """
    parts, at = [], 0
    for token, inside in _scan(regex):
        at = at + len(token) if regex.startswith(token, at) else -len(regex) - 1
        before = _BEFORE.match(regex, at) if token == "\\b" and not inside and at > 0 else None
        if before:  # the class again, which costs less to test than what is behind
            parts.append(f"(?={before[0]})(?<![0-9A-Za-z_])")
        elif token == "\\b" and not inside and at > 0 and _AFTER.search(regex[: at - 2]):
            parts.append("(?![0-9A-Za-z_])")
        elif token == "\\b" and not inside:
            parts.append(_EDGE)
        elif token == "\\B" and not inside:
            parts.append(_INNER)
        elif inside and token in ("[", "&"):
            parts.append("\\" + token)
        else:
            parts.append(token)
    return "".join(parts)


@lru_cache(4096)
def to_python(regex: str) -> re.Pattern[str]:
    """The rule compiled for Python, ASCII classes."""
    return re.compile("".join(t if not (inside and t == "[") else "\\[" for t, inside in _scan(regex)), re.ASCII)


@lru_cache(4096)
def to_re2(regex: str) -> str:
    """The rule for RE2 (Arrow kernels, DuckDB); POSIX classes are written out."""
    return "".join(t if not (inside and t == "[") else "\\[" for t, inside in _scan(regex))


def java_replacement(text: str) -> str:
    """A replacement taken literally by ``regexp_replace``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def sql_string(text: str) -> str:
    """A SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"


#: Characters after a backslash that stand for themselves in a literal prefix.
_PLAIN_ESCAPES = frozenset("-_.@:/")


def extract_literal(regex: str) -> str | None:
    """The literal text a regex begins with, if it has at least three characters."""
    text = regex.removeprefix("^").removeprefix("\\A")
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            if text[i + 1 : i + 2] not in _PLAIN_ESCAPES or i + 1 >= len(text):
                break
            out.append(text[i + 1])
            i += 2
            continue
        if c in ".^$*+?()[]{}|":
            if c in "*?{" and out:
                out.pop()
            break
        out.append(c)
        i += 1
    found = "".join(out)
    return found if len(found) >= 3 else None
