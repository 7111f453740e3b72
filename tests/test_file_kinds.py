import duckdb

import __spark_entry__


def test_kinds_of_all_endings_are_those_of_the_sql(spark, tmp_path):
    spark.range(24).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = {tuple(r) for r in __spark_entry__.queries()["file_kinds"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        assert found == set(db.execute(__spark_entry__.oracle_sql()["file_kinds"]).fetchall())
    assert ("/in/7.tar.zip", "zip", None) in found and ("/in/5", None, "Unsupported file type: ") in found
