"""The preprocessor on odd tables: nulls, constants, no labels, no rows; as its SQL has them."""

import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize(
    ("rows", "n_chars", "quality", "labelled"),
    [(50, "IF(id % 5 = 2, NULL, id)", "id % 2", 20), (50, "id", "1", 20), (50, "id", "0", 50), (50, "id", "NULL", 50), (50, "7", "id % 2", 0), (50, "NULL", "id % 2", 30), (0, "id", "id", 0)],
)
def test_preprocessor_has_both_features(spark, tmp_path, rows, n_chars, quality, labelled):
    spark.range(rows).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "'a' AS source", f"CAST({n_chars} AS LONG) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(labelled).selectExpr("id AS doc_id", f"CAST({quality} AS INT) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()["preprocessor"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["preprocessor"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 2
