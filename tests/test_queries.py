"""Queries of single steps against their SQL, on the smallest tables."""

import pathlib

import duckdb
import pytest

from kelpmill.operators import catalog
from kelpmill.plans import expressions, steps
from kelpmill.sources import tables

FOLDER = pathlib.Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", list(steps.QUERIES))
def test_against_sql(spark, name):
    query, sql = steps.QUERIES[name]
    got = query(spark, str(FOLDER))
    names = sorted(got.columns)
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(sql)
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_labels_and_types_of_white_space(spark):
    rows = [("1", "bank", None, "k", "  ", " ENUM ", None, None, None, None), ("2", "bank", None, "m", "", "", None, None, None, None)]
    items = catalog.global_items(spark.createDataFrame(rows, tables.SCHEMAS["catalog_global"]))
    assert {(r._id, r.label, r.type) for r in items.collect()} == {("1", "", "enum"), ("2", "m", "string")}
    ref = lambda key, label, kind: (None, key, label, kind, None, None, None)
    docs = spark.createDataFrame([("d", "domain", "bank", "x", None, [ref("k", " L ", " Date "), ref("m", "", None), None], None)], tables.SCHEMAS["catalog_domain"])
    assert {(r.attribute_key, r.label, r.type) for r in catalog.resolve_refs(docs, items).collect()} == {("k", "L", "date"), ("m", "m", "string")}


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
def test_norms_and_own_cosines(spark):
    query, sql = expressions.QUERIES["vector_norm"]
    want = duckdb.connect().sql(sql.replace("FROM embeddings", f"FROM '{FOLDER}/embeddings.parquet'")).fetchall()
    got = query(spark, str(FOLDER))
    assert got.columns == ["vec_id", "norm", "own_cosine"] and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")
def test_a_domain_is_counted_before_it_meets_requests(spark):
    query, sql = expressions.QUERIES["filter_catalog_domain"]
    got = query(spark, str(FOLDER))
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(sql).fetchall())
    assert "Aggregate [domain" in got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
