import pytest

from veilspark.functions.model import redact_text
from veilspark.operators.cascade import Cascade
from veilspark.operators.rules import RuleSet
from veilspark.plans import queries as plans

RECORDS = [
    "visit patient_id=P12 MRN: A1B2C312 seen", "swipe card_number=411111111111234 cvc: 123 ok", "consent_id: c-12 VAT DE123451234 end", "call request_id=r-12 done",
    "to user1@10.0.0.7 from 10.1.1.1", *(x.replace("{n}", "12").replace("{m}", "7").replace("{p}", "0123") for x in plans.TEMPLATES),
]
TEXTS = [None, "", "no secrets here", "\n".join(RECORDS), "plain line\n" * 500 + "\n".join(RECORDS * 40), *RECORDS]
SETS = {
    "redact_catalog_documents": RuleSet.builtin().union(RuleSet.categories()), "merge_spans_documents": plans.OVERLAPPING,
    **{f"redact_profile_{p}_documents": RuleSet.profiles(p) for p in ("hipaa", "pci", "gdpr", "soc2")},
}


def complete(rules, text):
    redacted, spans, hits = redact_text(rules, text)
    return redacted, len(spans), hits


def cascade(rules, text):
    found = [Cascade(rules).redact_line(x) for x in text.split("\n")]
    return "\n".join(x.redacted for x in found), sum(len(x.spans) for x in found), sum(x.hits for x in found)


@pytest.mark.parametrize("name", [*SETS, "redact_cascade_documents"])
def test_every_line_of_documents(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    brute, rules = (complete, SETS[name]) if name in SETS else (cascade, RuleSet.builtin())
    got = {r.doc_id: (r.redacted, r.n_spans, r.n_hits) for r in plans.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None, None) if x is None else brute(rules, x) for i, x in enumerate(TEXTS)}
    assert got[4][1] == 40 * got[3][1] > 0


def test_all_hits_has_no_limit(spark, tmp_path):
    found = [f"10.0.{i // 250}.{i % 250}" for i in range(300)]
    texts = [" ".join(found), "\n".join(found), "none", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.matches, r.n) for r in plans.queries()["all_hits"](spark, str(tmp_path)).collect()}
    assert got == {0: (" ".join(found), 300), 1: (" ".join(found), 300), 2: ("", 0), 3: ("", 0)}


def test_null_texts_are_reassembled(spark, tmp_path):
    rows = [(1, "a\nb"), (2, None), (3, ""), (4, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, plans.queries()["reassembled_documents"](spark, str(tmp_path)).collect())) == rows
