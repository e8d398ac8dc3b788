"""A mean that is a tie of the sixth decimal is rounded as the SQL does."""

import duckdb

import __spark_entry__


def test_preprocessor_rounds_ties_as_its_sql(spark, tmp_path):
    docs = spark.range(640).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "'a' AS source", "id % 7 AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(640).selectExpr("id AS doc_id", "CAST(id < 41 AS INT) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()["preprocessor"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["preprocessor"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and dict((r[0], r[2]) for r in got)["quality"] == 0.064062
