"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import json
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quillmark.plans import chain_queries, file_queries
from quillmark.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, tmp_path, name):
    QUERIES[name](spark, FOLDER).write.parquet(str(tmp_path / "out"))
    duck.sql(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLES[name]}")
    duck.sql(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    want, have = ({r[0]: r[1] for r in duck.sql(f"DESCRIBE {t}").fetchall()} for t in ("want", "got"))
    assert sorted(want) == sorted(have)
    cols = ", ".join(f'"{c}"' for c in sorted(want))
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_queries_without_sql_run(spark):
    for name in sorted(QUERIES.keys() - ORACLES.keys()):
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["semi_join_universe"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "o_orderdate" not in plan


def landed_files(monkeypatch, module):
    """Files that the queries of ``module`` land, before they are taken away."""
    files, taken = [], module.taken

    def look(df, folder):
        files.extend(p.read_text() for p in Path(folder.removeprefix("file:")).glob("part-*") if p.stat().st_size)
        return taken(df, folder)

    monkeypatch.setattr(module, "taken", look)
    return files


def test_files_of_filing_lists_have_a_size(spark, monkeypatch):
    """More companies are more files, not a larger one."""
    want = sorted(map(tuple, QUERIES["latest_filing"](spark, FOLDER).collect()))
    files = landed_files(monkeypatch, file_queries)
    monkeypatch.setattr(file_queries, "_LISTED", 100, raising=False)
    assert sorted(map(tuple, QUERIES["latest_filing"](spark, FOLDER).collect())) == want
    sizes = [sum(len(c["filings"]["recent"]["form"]) for c in json.loads(f)) for f in files]
    assert sum(sizes) == spark.read.parquet(f"{FOLDER}/orders.parquet").count() and len(sizes) > 10 and max(sizes) < 300


def test_documents_of_facts_have_a_size(spark, monkeypatch):
    """More points of a company are more documents, not a larger one; units and
    points keep their order over the pages."""
    want = sorted(map(tuple, QUERIES["facts_long"](spark, FOLDER).collect()))
    files = landed_files(monkeypatch, chain_queries)
    monkeypatch.setattr(chain_queries, "_PAGE", 100, raising=False)
    assert sorted(map(tuple, QUERIES["facts_long"](spark, FOLDER).collect())) == want
    sizes = [sum(len(points) for tags in json.loads(f)["facts"].values() for node in tags.values() for points in node["units"].values()) for f in files]
    assert sum(sizes) == spark.read.parquet(f"{FOLDER}/orders.parquet").count() and len(sizes) > 50 and max(sizes) <= 100
