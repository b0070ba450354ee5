"""The driver contract."""

import __spark_entry__ as entry

from marginalia import catalogue


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "n_sentences", "n_raw", "n_kept", "n_redundant"]
