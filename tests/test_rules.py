import pyarrow as pa
import pytest

from veilspark.functions import examples
from veilspark.functions.dialect import extract_literal, to_java, to_python
from veilspark.functions.model import redact_line
from veilspark.operators.arrow import Policy, compiled
from veilspark.operators.builtin import PROFILES
from veilspark.operators.rules import Reject, Rule, RuleSet, parse_rule


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# comment", None),
        ("   ", None),
        ("  n|lit|re|rep", ("n", "lit", "re", "rep")),
        ("n||regex|repl", ("n", "", "regex", "repl")),
        ("n|lit|a(?:x|y)b|repl", ("n", "lit", "a(?:x|y)b", "repl")),
        ("n|lit|regex", ("n", "lit", "regex", "")),
        ("n|lit|(a|b)", ("n", "lit", "(a|b)", "")),
    ],
)
def test_parse(text, expected):
    found = parse_rule(text)
    assert found is None if expected is None else (found.name, found.literal, found.regex, found.replacement) == expected


@pytest.mark.parametrize("text", ["n|lit", "n|lit|[|rep", "|lit|re|rep", "n|lit||rep"])
def test_rejects(text):
    assert isinstance(parse_rule(text, "f", 3), Reject)


def test_files(tmp_path):
    (tmp_path / "b.txt").write_text("two|b|b+|\n")
    (tmp_path / "a.txt").write_text("# c\none|a|a+|[A]\nbad|x\n")
    (tmp_path / ".hidden.txt").write_text("no|x|x|x\n")
    rules = RuleSet.from_dir(tmp_path)
    assert [r.name for r in rules] == ["one", "two"] and rules.rejects[0].line == 3
    assert rules[0].tag == "[A]" and rules[1].tag == "[REDACTED:two]"
    with pytest.raises(ValueError):
        RuleSet.from_file(tmp_path / ".." / "x.txt")
    with pytest.raises(ValueError):
        RuleSet.from_file(tmp_path / "a.txt", root=tmp_path / "other")


def test_counts_and_profiles():
    assert len(RuleSet.builtin()) == 14
    assert {k: len(v) for k, v in PROFILES.items()} == {"hipaa": 27, "pci": 16, "gdpr": 24, "soc2": 24}
    assert len(RuleSet.profiles("all")) == 91
    with pytest.raises(ValueError):
        RuleSet.profiles("none")


EVERY = RuleSet.builtin().union(RuleSet.profiles("all")).union(RuleSet.categories())
#: Lines as they stand in logs, and the rule of the catalog that must find something in them.
SEEN = {
    "facebook_token": "token=EAA" + "Bc1" * 30, "google_tag": "gtag GTM-ABC1234 loaded", "google_analytics": "ga UA-123456-1", "npm_auth": "//registry.npmjs.org/:_authToken=abcdef0123456789abcdef", "discover": "card 6011000990139424 ok",
    "diners": "card 30569309025904 ok", "jcb": "card 3530111333300000 ok", "card_expiry": "exp: 12/27 ok", "us_phone": "call (555) 123-4567 or later", "international_phone": "ring +44 20 7946 0958 now", "postgres_url": "DATABASE_URL=postgres://app:s3cret@db/x",
    "stripe_secret": "sk_live_" + "a1B2" * 6, "sendgrid_key": f"SG.{'a' * 22}.{'b' * 43}", "discord_webhook": f"https://discord.com/api/webhooks/123456789012345678/{'x' * 64}", "docker_auth": '{"auths":{"r":{"auth": "dXNlcjpwYXNzd29yZA=="}}}',
}


@pytest.mark.parametrize("rule", EVERY, ids=lambda r: r.name)
def test_every_rule_has_a_hit_and_a_near_miss(rule):
    one = RuleSet.of([rule])
    assert rule.tag in redact_line(one, examples.hit(rule)).redacted
    assert redact_line(one, examples.miss(rule)).hits == 0
    every = [examples.hit(rule), examples.miss(rule)]
    assert compiled(one, Policy(), False).redact(pa.array(every)).to_pylist() == [redact_line(one, x).redacted for x in every]


@pytest.mark.parametrize("name", SEEN)
def test_lines_of_logs(name):
    rule = next(r for r in EVERY if r.name == name)
    assert redact_line(RuleSet.of([rule]), SEEN[name]).hits


def test_all_rules_at_once_are_the_model():
    lines = [line for _, _, line in examples.examples(EVERY)]
    assert compiled(EVERY, Policy(), False).redact(pa.array(lines)).to_pylist() == [redact_line(EVERY, x).redacted for x in lines]


def test_union_keeps_rules_with_one_literal():
    both = RuleSet.of([Rule("a", "DE", "DE[0-9]+")]).union(RuleSet.of([Rule("b", "DE", "DE[A-Z]+"), Rule("a", "DE", "DE[0-9]+")]))
    assert [r.name for r in both] == ["a", "b"]


def test_lint():
    kinds = {x.kind for x in RuleSet.of([Rule("a", "", r"(a+)+"), Rule("b", "", r"x\\s"), Rule("c", "", "[a-z]+"), Rule("c", "", "abc[0-9]")]).lint()}
    assert kinds == {"nested_repetition", "doubled_backslash", "broad", "repeated_name", "no_literal"}


@pytest.mark.parametrize(("regex", "literal"), [("AKIA[0-9A-Z]{16}", "AKIA"), (r"^sk\_live\_x", "sk_live_x"), ("ab", None), ("abcd*", "abc"), (r"\bfoo", None)])
def test_extract_literal(regex, literal):
    assert extract_literal(regex) == literal


def test_dialects(spark):
    from pyspark.sql import functions as F

    text = "é123-45-6789 and 123-45-6789"
    rule = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
    n = spark.range(1).select(F.regexp_count(F.lit(text), F.lit(to_java(rule)))).first()[0]
    assert n == len(to_python(rule).findall(text)) == 2


def test_catalog_table_round_trip(spark):
    rules = RuleSet.builtin()
    assert RuleSet.from_table(rules.to_df(spark)).fingerprint() == rules.fingerprint()
