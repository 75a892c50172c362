"""Every registered query at the smallest scale: against its SQL, or for its rows."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
STATEMENTS = {n: s for n, s in entry.oracle_sql().items() if n not in entry.CORPUS_QUERIES}
QUERIES = {n: q for n, q in entry.queries().items() if n not in entry.CORPUS_QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, STATEMENTS[name]) is None


def test_statements_belong_to_queries():
    assert set(STATEMENTS) == set(QUERIES)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 <= row.accuracy <= 1 and row.test_size > 0


def test_one_file_is_only_copied_by_one_task(spark, monkeypatch):
    from kinvote.sources import writers

    plans, write = [], writers.write_csv

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *args, **options)

    monkeypatch.setattr(writers, "write_csv", seen)
    assert QUERIES["sink_csv_single_file"](spark, FOLDER).first().n_files == 1
    assert len(plans) == 1 and "Join" not in plans[0] and "regexp" not in plans[0]


def test_the_one_task_reads_well_compressed_parts(spark, monkeypatch):
    from kinvote.sources import writers

    read, write = [], writers.write_csv
    monkeypatch.setattr(writers, "write_csv", lambda df, *args, **options: read.extend(df.inputFiles()) or write(df, *args, **options))
    assert QUERIES["sink_csv_single_file"](spark, FOLDER).count() > 0
    assert read and all(name.endswith(".zstd.parquet") for name in read)
