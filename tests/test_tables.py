"""Queries on documents whose numbers take the files past 999, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark.functions import grid
from gridspark.jobs.oracles import ORACLES
from gridspark.jobs.queries import QUERIES

NAMES = ("fn1_valid", "fn2_counts", "fn3_parse_error", "fn4_normalised", "fn5_transform", "fn6_orbit", "fn7_canonical", "fn8_condition", "fn9_encode", "fn10_decode", "fn11_level_id", "fn12_bucket", "fn15_path_counts", "lbl1_labels")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Documents of files 0 to 1, 99 to 101, 999 to 1,001 and 10,009 to 10,011, in two sources."""
    path = tmp_path_factory.mktemp("tables")
    numbers = " OR ".join(f"d BETWEEN {lo} AND {lo + 120}" for lo in (0, 9_980, 99_940, 1_000_980))
    duckdb.sql(f"COPY (SELECT d::bigint AS doc_id, 'src' || (d % 2 * 9)::varchar AS source, (d * 37 % 500)::bigint AS n_chars FROM range(0, 1001200) r(d) WHERE {numbers}) TO '{path}/documents.parquet'")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_the_rows_are_those_of_the_sql(spark, tables, name):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
        want = db.sql(ORACLES[name])
        columns, want = want.columns, sorted(map(str, want.fetchall()))
    got = QUERIES[name](spark, tables)
    assert got.columns == columns and sorted(str(tuple(r)) for r in got.collect()) == want


def test_the_id_of_a_level_keeps_all_digits_of_its_file(spark):
    rows = spark.createDataFrame([("s", 7, 3), ("s", 999, 0), ("s", 1000, 0), ("s", 10009, 42)], "source string, file int, index int")
    ids = [r[0] for r in rows.select(grid.level_id(F.col("source"), F.col("file"), F.col("index"))).collect()]
    assert ids == ["s/007#3", "s/999#0", "s/1000#0", "s/10009#42"]
