"""Parity mode: the lossy cascade of gate, hot rules and cold literals, kept apart from the complete mode.

1. Gate: a line without any of the fixed words is left as it is.
2. Hot rules: literals of some named rules; if any of them verifies, only these spans are applied.
3. Cold literals, in order of the end of their occurrence, at most 64; of rules with equal literals the last one is
   tried; rules without a literal never are. The regex may begin at most 11 characters before the literal.
"""

from __future__ import annotations

from veilspark.functions.model import Redaction, Span, merge_spans, replace_spans
from veilspark.operators.rules import RuleSet

# Names of the hot rules, words of the gate, look-back and cap.
HOT_NAMES = (
    "password_value secret_value api_key_value token_value credential_value aws_access_key github_personal_access_token email_address "
    "generic_api_key generic_api_secret generic_auth_token bearer_token generic_password generic_secret_key visa mastercard amex ssn "
    "private_key_path generic_db_password"
).split()
GATE = (
    "password secret token AKIA ghp_ sk_live_ postgres:// mongodb:// -----BEGIN xoxb- eyJ Bearer api_key credential key "
    "MRN NPI diagnosis patient beneficiary ICD glucose A1C blood heart_rate encounter prescription Rx "
    "cardholder %B PIN track card_number cvv merchant "
    "IBAN NINO DNI NIE INSEE codice_fiscale driving_licen "
    "audit_id session_id role permission acl privilege encryption_key signing_key master_key mfa totp recovery_code kms"
).split()
LOOK_BACK, MOST_HITS = 11, 64


class Cascade:
    """The compiled cascade of a rule set."""

    def __init__(self, rules: RuleSet) -> None:
        self.rules = rules
        self.tags = [r.tag for r in rules]
        first = {}
        for i, r in enumerate(rules):
            first.setdefault(r.name, i)
        self.hot = {rules[first[n]].literal: first[n] for n in HOT_NAMES if n in first and rules[first[n]].literal}
        self.cold = {r.literal: i for i, r in enumerate(rules) if r.literal}

    def _hits(self, line: str, literals: dict[str, int]) -> list[tuple[int, int, int]]:
        """(end, start, rule) of every occurrence, overlapping ones too, in order of the end, the longer first."""
        found = []
        for literal, rule in literals.items():
            at = line.find(literal)
            while at >= 0:
                found.append((at + len(literal), at, rule))
                at = line.find(literal, at + 1)
        return sorted(found)[:MOST_HITS]

    def _verify(self, line: str, hits: list[tuple[int, int, int]]) -> tuple[list[Span], int]:
        spans = []
        for _, start, rule in hits:
            m = self.rules[rule].pattern.search(line, max(0, start - LOOK_BACK))
            if m and m.end() > m.start():
                spans.append(Span(m.start(), m.end(), rule))
        return spans, len(spans)

    def redact_line(self, line: str) -> Redaction:
        if not any(w in line for w in GATE):
            return Redaction(line, [], 0)
        spans, hits = self._verify(line, self._hits(line, self.hot)) if self.hot else ([], 0)
        if not spans:
            spans, hits = self._verify(line, self._hits(line, self.cold))
        if not spans:
            return Redaction(line, [], 0)
        merged = merge_spans(spans)
        return Redaction(replace_spans(line, merged, self.tags), merged, hits)
