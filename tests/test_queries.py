"""Every registered query against its SQL, and independence of the partition count."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(clean, key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = canonical(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got[1]) > 0
        return
    rel = db.sql(sql)
    assert got == canonical(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["canonical", "feature_table", "impute_cubic", "knn_stations", "exact_quantiles", "watershed"])
def test_partition_count_does_not_matter(spark, name):
    results = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            df = entry.queries()[name](spark, SF_DIR)
            results.append(canonical(df.columns, df.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
