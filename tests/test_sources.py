"""Round trips through files."""

from pyspark.sql import functions as F

from quern.session import table
from quern.sources import files as S


def test_csv(spark, small, tmp_path):
    df = table(spark, small, "nation")
    S.write_csv(df, f"{tmp_path}/n", delim=";", force_quote=True)
    back = S.read_csv(spark, f"{tmp_path}/n", delim=";", schema="n_nationkey int, n_name string, n_regionkey int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.csv").write_text('a,b\n1,x\ntwo,y\n3,"1,234"\n')
    found = S.read_csv(spark, f"{tmp_path}/bad.csv", schema="a int, b string", rejects=True).cache()
    assert found.filter("_reject IS NOT NULL").count() == 1 and found.filter("_reject IS NULL").count() == 2
    assert S.sniff_csv(spark, f"{tmp_path}/bad.csv")["delimiter"] == ","


def test_parquet(spark, small, tmp_path):
    df = table(spark, small, "orders")
    S.write_parquet(df, f"{tmp_path}/o", partition_by=["o_orderstatus"], bloom=["o_custkey"], sort_by=["o_custkey"], max_rows=500)
    back = S.read_parquet(spark, f"{tmp_path}/o", filename=True, file_row_number=True)
    assert back.count() == df.count() and {"filename", "file_row_number", "o_orderstatus"} <= set(back.columns)
    plan = back.filter("o_orderstatus = 'F' AND o_custkey = 3").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan and "EqualTo(o_custkey,3)" in plan
    part = S.glob(spark, f"{tmp_path}/o/o_orderstatus=F/*.parquet")
    assert part and S.parquet_metadata(part[0].removeprefix("file:"))[0]["num_values"] > 0 and S.parquet_schema(part[0].removeprefix("file:"))
    a, b = spark.range(2).select("id"), spark.range(2).select(F.col("id").alias("x"))
    S.write_parquet(a, f"{tmp_path}/a")
    S.write_parquet(b, f"{tmp_path}/b")
    assert set(S.read_parquet(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], union_by_name=True).columns) == {"id", "x"}


def test_json_text_blob(spark, small, tmp_path):
    df = table(spark, small, "region")
    df.write.json(f"{tmp_path}/j")
    assert sorted(map(tuple, S.read_json(spark, f"{tmp_path}/j", "r_regionkey int, r_name string").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "whole.json").write_text('[{"a": 1}, {"a": 2}]')
    assert S.read_json(spark, f"{tmp_path}/whole.json", lines=False).count() == 2
    assert S.read_json_objects(spark, f"{tmp_path}/whole.json").columns == ["json"]
    assert S.read_text(spark, f"{tmp_path}/whole.json").first()["content"].startswith("[") and S.read_blob(spark, f"{tmp_path}/whole.json").first()["size"] == 20


def test_export(spark, small, tmp_path):
    S.export_database({"nation": table(spark, small, "nation")}, f"{tmp_path}/db")
    assert S.import_database(spark, f"{tmp_path}/db", ["nation"])["nation"].count() == 25


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = table(spark, small, "lineitem").filter("l_quantity < 5").groupBy("l_returnflag").count()._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,5.0)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
