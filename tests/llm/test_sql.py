"""Corpus queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quillmark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tmp_path, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    QUERIES[name](spark, FOLDER).write.parquet(str(tmp_path / "out"))
    c.sql(f"CREATE TABLE want AS {ORACLES[name]}")
    c.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    cols = ", ".join(f'"{r[0]}"' for r in c.sql("DESCRIBE want").fetchall())
    for a, b in (("want", "got"), ("got", "want")):
        assert c.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
