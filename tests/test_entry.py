import os
import sys

import pytest

import __spark_entry__ as entry


def test_every_query_with_sql_is_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.oracle_sql()) > 100


def test_works_without_the_training_data_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = entry.queries()
    assert found and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in found)


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_index", "precision", "recall", "f1"]
    assert all(0 <= r.precision <= 1 and 0 <= r.recall <= 1 and r.f1 <= max(r.precision, r.recall) + 1e-9 for r in df.collect())
