import builtins
import os
from collections import Counter

import pytest

import __spark_entry__ as E
from veilspark.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(plans.queries()) <= set(E.queries())


def _key(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_is_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = plans.queries()[name](spark, SF)
    result = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = Counter(tuple(map(_key, r)) for r in result.fetchall())
    assert Counter(tuple(map(_key, (row[c] for c in columns))) for row in df.collect()) == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and {"doc_id", "redacted", "n_spans"} <= set(df.columns)


def test_without_the_training_data_folder(monkeypatch):
    own = builtins.__import__

    def blocked(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("veilspark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return own(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", blocked)
    assert set(E.queries()) == set(plans.queries())
