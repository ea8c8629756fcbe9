"""Every registered query with SQL against DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, d, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    got = query(spark, d)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", ["engine_compact_scan", "engine_flush_get", "engine_ingest"])
def test_matches_sql_when_each_batch_fills_the_table(spark, name, monkeypatch):
    engine, made = catalogue._engine, []
    monkeypatch.setattr(catalogue, "_engine", lambda s, **settings: made.append(engine(s, memtable_max_size_bytes=1000, **settings)) or made[-1])
    compare(spark, "/root/testdata/sf0.001", catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert made and made[0].pending_bytes() == 0


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 868
