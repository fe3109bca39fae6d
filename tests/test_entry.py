import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() == 11 and "unique_count" in rows.columns


def test_queries_without_sql():
    """Only operators on training data may lack SQL; their own tests hold them against brute force."""
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") and name[2].isdigit() for name in without)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    fine, text = compare(spark, FOLDER, name, entry.queries(), entry.oracle_sql())
    assert fine, text


def test_only_an_absent_subpackage_is_passed_over():
    assert entry.optional(ModuleNotFoundError(name="tablehealth.llm"))
    assert entry.optional(ModuleNotFoundError(name="corpus_pipeline"))
    assert not entry.optional(ModuleNotFoundError(name="sentencepiece"))
