"""Every registered query of the log engine against DuckDB."""

import duckdb
import pytest

from logspark import queries
from logspark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows], key=str), sorted(columns)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in SQL
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [d[0] for d in result.description]
        assert _rows(rows, df.columns) == _rows(result.fetchall(), columns)


def test_labels_beyond_long_logs(spark, tmp_path):
    duck = duckdb.connect()
    few = f"select * from (select * from '{SF}/events.parquet' order by event_id limit 300)"
    duck.execute(f"copy ({few} union all select * replace (event_id + 1000000 as event_id) from ({few})) to '{tmp_path}/events.parquet' (format parquet)")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = QUERIES["label_remap"](spark, str(tmp_path))
    result = duck.execute(SQL["label_remap"])
    columns = [d[0] for d in result.description]
    assert _rows(df.collect(), df.columns) == _rows(result.fetchall(), columns)


@pytest.mark.parametrize("name", ["source_text_file", "source_gzip_file", "source_file_entries", "source_csv_truth"])
def test_logs_in_parts(spark, duck, name, monkeypatch):
    written, kept = [], queries._written
    monkeypatch.setattr(queries, "LOG_LINES", 300)
    monkeypatch.setattr(queries, "_written", lambda *a, **k: written.append(kept(*a, **k)) or written[-1])
    df = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert _rows(df.collect(), df.columns) == _rows(result.fetchall(), columns)
    assert len(spark.read.text(written[0]).inputFiles()) > 1
