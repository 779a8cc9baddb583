"""The roll-up of files' metadata and the count of their items: one shuffle and one sort, odd rows as in their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumaspark.operators import items
from lumaspark.plans import catalog


@pytest.mark.parametrize("name", ["metadata_rollup", "item_limits"])
def test_one_shuffle_one_sort_and_no_hash_table(spark, name):
    text = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count(" Sort [") == 1
    assert not any(w in text for w in ("Join", "HashAggregate"))


@pytest.mark.parametrize("name", ["metadata_rollup", "item_limits"])
@pytest.mark.parametrize("rows", [[], [(1, 3), (1, 2), (1, 3), (2, None), (2, None), (3, 9), (3, None), (3, 9), (None, 1), (None, None), (4, 0), (4, -1)], [(i % 7, i % 5) for i in range(200)]])
def test_odd_lines(spark, tmp_path, rows, name):
    keys, numbers = ([r[i] for r in rows] for i in (0, 1))
    rest = {c: pa.array([1] * len(rows), pa.int64()) for c in ("l_partkey", "l_suppkey", "l_quantity")} | {"l_extendedprice": pa.array([1.0] * len(rows)), "l_returnflag": pa.array(["A"] * len(rows))}
    pq.write_table(pa.table({"l_orderkey": pa.array(keys, pa.int64()), "l_linenumber": pa.array(numbers, pa.int32())} | rest), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_primary_items_given_apart(spark):
    schema = "file_id long, item_id long, item_type string, width long, height long, color_space string, orientation int, is_alpha boolean"
    rows = spark.createDataFrame([(1, 1, "hvc1", 10, 20, "srgb", 1, True), (1, 2, "grid", 30, 40, "rec2020", 6, False), (2, 5, "hvc1", 1, 1, "srgb", 1, False)], schema)
    found = items.metadata_rollup(rows, spark.createDataFrame([(1, 2), (2, 7)], "file_id long, item_id long"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2, 30, 40, "rec2020", 6, True, True), (2, 7, 1, None, None, None, None, False, False)]
