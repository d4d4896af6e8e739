import __spark_entry__ as entry


def test_every_oracle_has_a_query_and_imports_need_no_session():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_flagship_query_runs(spark):
    assert entry.entry(spark).columns == ["document_id", "blocks", "text_blocks", "lines", "characters"]
