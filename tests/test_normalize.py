from pyspark.sql import functions as F

from tenderspark.functions import normalize as N


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_keys(spark):
    assert run(spark, N.cage_frame, [" 1ab ", "123456", "nan", None, ""]) == ["001AB", "123456", "", "", ""]
    assert run(spark, N.cage_sql, ["1-a b", "123456", "none", "NAN"]) == ["001AB", "12345", None, None]
    assert run(spark, N.naics, ["336411.0", " 541330 ", "nan", None]) == ["336411", "541330", "", ""]
    assert run(spark, N.niin_input, ["5945-01-485-1472", "14851472", ""]) == ["014851472", "014851472", "000000000"]
    assert run(spark, N.niin_of_nsn, ["123", "5945014851472"]) == [None, "014851472"]


def test_words(spark):
    assert run(spark, lambda c: N.null_words(c, N.CATEGORY_NULLS), ["NAN", "NAN.0", "NONE", "UNKNOWN", " ", "f-16 "]) == [None] * 5 + ["F-16"]
    assert run(spark, N.vendor, ["Boeing", "the boeing ", "BOEING CO", "BOEING COMPANY"]) == [N.VENDOR_NAME] * 3 + ["BOEING COMPANY"]
    assert run(spark, N.no_year_suffix, ["ACME (2021) ", "ACME (21)"]) == ["ACME", "ACME (21)"]
    assert run(spark, N.title_case, ["PLUG,PROTECTIVE O-RING"]) == ["Plug,Protective O-Ring"]
    assert run(spark, N.after_bang, ["a!b!c", "none", None]) == ["b!c", "none", None]


def test_trends(spark):
    assert run(spark, lambda c: N.trend_sum(c, [2020, 2021]), ["2020:10|2021:5", "2020:1|x:y|2021:5", "2020:1|2021:2:3", "", None]) == [15.0, 1.0, 1.0, 0.0, 0.0]
    assert run(spark, lambda c: N.trend_sum(c, []), ["2020:10"]) == [0.0]
    assert run(spark, N.trend_map, ["2020:1|bad|2021:z|2022:3", "2020:1|2020:2", None]) == [{2020: 1.0, 2022: 3.0}, {2020: 2.0}, {}]


def test_numbers(spark):
    assert run(spark, N.fiscal_order, [9, 10, 12, 1, None], "int") == [12, 1, 3, 4, 4]
    assert run(spark, N.spend_tier, [0.0, 1e5, 100000.01, 1e6, 1e6 + 1, -2.0], "double") == ["Zero", "<100k", "100k-1M", "100k-1M", ">1M", None]
    assert run(spark, N.json_safe, [1.0, float("inf"), float("nan"), None], "double") == [1.0, None, None, None]
    df = spark.createDataFrame([(0.0, 0.0), (4.0, 0.0)], "p double, u double")
    assert df.agg(N.weighted_price(F.col("p"), F.col("u")).alias("x")).first().x == 4.0
    years = N.filled_years(spark.createDataFrame([(2018, 1.0), (2021, 2.0)], "year int, amount double")).orderBy("year").collect()
    assert [(r.year, r.amount) for r in years] == [(2018, 1.0), (2019, 0.0), (2020, 0.0), (2021, 2.0)]
