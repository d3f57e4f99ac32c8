"""Registered queries over a written folder of awkward tables against their own SQL in DuckDB."""
from __future__ import annotations

import random

import duckdb
import pytest
from cases import awkward_texts, prose

from cohortlens.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    texts = list({i: t for i, t in awkward_texts() if i is not None}.items())
    passages = [(i, t) for i, t in texts if t and len(t.split()) > 30]
    items = [("whole", passages[0][1]), ("part", " ".join(passages[2][1].split()[5:30]).upper()), ("short", "kara LOBEN, mi"),
             ("one", "solo"), ("none", prose(rng, 20)), ("blank", " ?! "), ("null", None), ("twin", "solo"), (None, "tab and blanks end")]
    bodies = ["", None, "<p>x</p>", "<p>x</p>", "<p>é两</p>", *(prose(rng, 5 + i % 3) for i in range(6))]
    pages = [(i, f"http://h/{i}", body) for i, body in enumerate(bodies + bodies[:4])]
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").repartition(2).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(result.fetchall(), key=key)
