"""All targets of a call are listed, as its SQL lists them."""

import duckdb

import __spark_entry__


def test_lexical_targets_lists_all_candidates(spark, tmp_path):
    """An order of 7 lines that all declare what all ask for, and nine orders of one line that call what the customer's orders declare."""
    orders = spark.range(1, 11).selectExpr("id AS o_orderkey", "5L AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "timestamp'2024-01-01' AS o_orderdate", "'x' AS o_orderpriority")
    lines = spark.range(16).selectExpr(
        "IF(id < 7, 1, id - 5) AS l_orderkey", "1L AS l_partkey", "1L AS l_suppkey", "CAST(id + 1 AS INT) AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice",
        "IF(id < 7, 0.02D, 0.01D) AS l_discount", "0.02D AS l_tax", "'A' AS l_returnflag", "'O' AS l_linestatus", "timestamp'2024-01-01' AS l_shipdate",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()["lexical_targets"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["lexical_targets"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sorted(r[2] for r in got) == [7] * 7 + [9] * 9
    assert all(len(r[3].split(",")) == r[2] for r in got)
