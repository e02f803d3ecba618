"""Season files read by a given schema or by merged ones."""

from pyspark.sql import functions as F

from fieldglass.sources.tables import read_seasons, write_parquet

SCHEMA = "season int, week int, epa double, added string"


def seasons(spark, tmp_path):
    old = spark.createDataFrame([(2020, 1, 0.5), (2020, 2, None)], "season int, week int, epa double")
    new = spark.createDataFrame([(2021, 1, 0.25, "x")], SCHEMA)
    write_parquet(old, f"{tmp_path}/play_2020.parquet")
    write_parquet(new, f"{tmp_path}/play_2021.parquet")
    return f"{tmp_path}/play_*.parquet"


def test_given_and_merged_schemas_read_the_same_rows(spark, tmp_path):
    path = seasons(spark, tmp_path)
    given, merged = read_seasons(spark, path, schema=SCHEMA), read_seasons(spark, path)
    names = ["season", "week", "epa", "added"]
    expected = {(2020, 1, 0.5, None), (2020, 2, None, None), (2021, 1, 0.25, "x")}
    assert {tuple(r) for r in given.select(*names).collect()} == expected
    assert {tuple(r) for r in merged.select(*names).collect()} == expected


def test_filters_and_columns_reach_the_reader_under_a_given_schema(spark, tmp_path):
    df = read_seasons(spark, seasons(spark, tmp_path), ["season", "epa"], SCHEMA).where(F.col("season") == 2021)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(season,2021)" in plan and "ReadSchema: struct<season:int,epa:double>" in plan
    assert [tuple(r) for r in df.collect()] == [(2021, 0.25)]
