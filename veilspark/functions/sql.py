"""The column functions under SQL names, and a table function of findings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql.functions import udtf

from veilspark.operators import arrow
from veilspark.operators.arrow import Policy, compiled
from veilspark.operators.rules import RuleSet

if TYPE_CHECKING:
    from veilspark.operators.engine import Redactor


def findings_function(rules: RuleSet, policy: Policy) -> type:
    """A table function ``findings_of(text)``: one row per finding."""
    own = RuleSet(rules.rules)

    class FindingsOf:
        def eval(self, text: str) -> Iterator[tuple]:
            if text is not None:
                c = compiled(own, policy, True)
                for f in (c.result(text, c.everywhere(text)) or {"findings": []})["findings"]:
                    yield f["rule_id"], f["name"], f["line_no"], f["start"], f["end"], f["match"]

    return udtf(FindingsOf, returnType="rule_id int, name string, line_no int, start int, end int, match string")


def register(redactor: Redactor, prefix: str) -> list[str]:
    spark, rules, policy = redactor.spark, redactor.rules, redactor.policy
    if spark is None:
        raise ValueError("no session to register functions in")
    own = {
        "redact": arrow.whole_udf(rules, policy, per_line=False), "redact_text": arrow.whole_udf(rules, policy),
        "findings": arrow.findings_udf(rules, policy), "has_sensitive": arrow.sensitive_udf(rules, policy),
    }
    for name, f in own.items():
        spark.udf.register(f"{prefix}{name}", f)
    spark.udtf.register(f"{prefix}findings_of", findings_function(rules, policy))
    return [f"{prefix}{name}" for name in (*own, "findings_of")]
