"""Every query with an SQL twin gives its rows on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from repolith.plans import catalog
from repolith.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings benchmark documents pages conversations labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 8) if isinstance(v, int | float) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    sql = db.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    rows = lambda data, names: sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in data)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), sql.columns)


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_flows_start_at_every_caller(spark):
    flows = catalog.queries()["execution_flow"](spark, SF)
    want = {(r.caller_file, r.caller_symbol) for r in Tables(spark, SF).calls().collect()}
    assert len(want) > 10 and {(r.entry_file, r.entry_symbol) for r in flows.collect()} == want


def test_files_made_of_a_small_table_are_read_in_many_tasks(spark):
    from repolith.plans.source_queries import _python

    made = _python(Tables(spark, SF))
    assert made.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    parts = Tables(spark, SF).part_keys().groupBy(F.spark_partition_id()).count().count()
    assert parts > 1
