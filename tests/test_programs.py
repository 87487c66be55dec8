"""Programmes of orders with more lines than the tables have."""

import duckdb
from pyspark.sql import functions as F

from admira import catalog
from admira.operators import pages as G


def test_every_programme_of_a_long_order(spark, sf_dir, tmp_path):
    line, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    line.withColumn("l_orderkey", F.col("l_orderkey") % 7).limit(700).write.parquet(f"{tmp_path}/lineitem.parquet")
    part.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, column in (("p13_extract_programs", "programs"), ("p15_extract_fees", "fees")):
        got = {r.o_orderkey: r[column] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        assert got == dict(con.sql(catalog.oracle_sql()[name]).fetchall())
        if column == "programs":
            assert max(v.count("|") for v in got.values()) > 20


def test_fees_and_programmes_of_odd_tables(spark):
    tables = "array<struct<headers:array<string>,rows:array<array<string>>>>"
    rows = [(None, None), ("Tuition fee is Rs 5000 a year.", []), ("", [([None, " Fee "], [[None, "a"], ["BS Law of Old", " 5 "], [], None])])]
    df = spark.createDataFrame(rows, f"content string, tables {tables}")
    fees = [r.f for r in df.select(G.extract_fees(F.col("content"), F.col("tables")).alias("f")).collect()]
    assert [tuple(x) for x in fees[2]] == [("BS Law of Old", "5")] and [x.label for x in fees[1]] == ["fee_snippet"]
