import duckdb
import pytest

import __spark_entry__ as entry
from fieldtrail.jobs import queries
from fieldtrail.streaming.usages import stream_usages

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def rows(records, columns):
    text = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(text(r[c]) for c in columns) for r in records)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows([dict(zip(columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    spark.createDataFrame([("r", "a.java", "int shelfNo;\nx")], "repo string, path string, text string").write.parquet(str(tmp_path / "in"))
    q = stream_usages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "shelfNo")
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["file"], r["line"], r["col"]) for r in got] == [("a.java", 1, 5)]
