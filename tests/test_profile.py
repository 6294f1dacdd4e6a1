"""Profiling operators (P1-P7) on the reference's literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from tabaudit.operators import profile as P


def one_col(spark, values, dtype="string", name="v"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"row_id long, {name} {dtype}")


def test_numeric_test(spark):
    assert P.numeric_test(one_col(spark, ["1.2", "3.3", "5.0"]), "row_id").first()["is_numeric"]
    assert not P.numeric_test(one_col(spark, ["A", "B", "5", "10.2"]), "row_id").first()["is_numeric"]


@pytest.mark.parametrize("sentinel,values,dtype", [
    (-99999, ["3", "2", "5", "-99999", "5", "2", "1"], "string"),
    ("-99999", ["3", "2", "5", "-99999", "5", "2", "1"], "string"),
    ("NULL", ["3", "2", "5", "NULL", "5", "2", "1"], "string"),
    ("nan", ["3", "2", "5", "nan", "5", "2", "1"], "string"),
    (float("nan"), [3.0, 2.0, 5.0, float("nan"), 5.0, 2.0, 1.0], "double"),
    (-99999, [3.0, 2.0, 5.0, -99999.0, 5.0, 2.0, 1.0], "double"),
])
def test_remove_missing(spark, sentinel, values, dtype):
    df = one_col(spark, values, dtype)
    kept = [r["v"] for r in P.remove_missing(df, "v", sentinel).orderBy("row_id").collect()]
    assert [float(v) for v in kept] == [3, 2, 5, 5, 2, 1]


def test_remove_missing_all(spark):
    df = one_col(spark, ["nan"] * 6)
    assert P.remove_missing(df, "v", "nan").count() == 0


def test_remove_missing_empty_string(spark):
    df = one_col(spark, ["a", "", "b"])
    assert P.remove_missing(df, "v", "-999999").count() == 2


def test_missing_indicator(spark):
    df = one_col(spark, ["1", "2", "3", "-999999", "4"])
    flags = [r[1] for r in P.missing_indicator(df, "row_id", ["v"], "-999999").orderBy("row_id").collect()]
    assert flags == [0, 0, 0, 1, 0]


def test_missing_indicator_ignores_empty(spark):
    df = one_col(spark, ["1", "", "-999999"])
    flags = [r[1] for r in P.missing_indicator(df, "row_id", ["v"], "-999999").orderBy("row_id").collect()]
    assert flags == [0, 0, 1]


def test_missing_rows(spark):
    df = one_col(spark, ["4", "5", "NULL", "2", "5", "3"])
    rows = P.missing_rows(df, "row_id", ["v"], "NULL").collect()
    assert [r["row_id"] for r in rows] == [2]


@pytest.mark.parametrize("counts,expected", [
    ({"hello": 20, "world": 17}, "world"),
    ({"hello": 20, "world": 20}, "hello"),
    ({"hello": 4, "world": 40}, "hello"),
])
def test_minority_class(spark, counts, expected):
    vals = [v for v, n in counts.items() for _ in range(n)]
    r = P.minority_class(one_col(spark, vals), ["v"]).first()
    assert r["minority"] == expected
    assert r["majority"] != expected


@pytest.mark.parametrize("values,dtype,expected", [
    ([str(i) for i in range(11)], "string", "count"),
    (["a", "b", "c", "d", "e", "f", "g"], "string", "categorical"),
    (["0", "1", "0", "1"], "string", "binary"),
    (["0"] * 5, "string", "constant"),
    (["hello"], "string", "constant"),
    ([i / 97.0 for i in range(50)], "double", "continuous"),
])
def test_variable_type(spark, values, dtype, expected):
    spec = P.profile(one_col(spark, values, dtype), "row_id")
    assert spec["v"].type == expected


def multimodal(spark, n=200, sentinel_row=None):
    rows = []
    for i in range(n):
        rows.append((i, "helloworld", "1" if i == n - 1 else "0", "B" if i == n - 1 else "A",
                     "XYZ"[i % 3], str(5 + i % 15), str((i * 37 % 101) / 101.0 + 0.001)))
    if sentinel_row is not None:
        r = list(rows[sentinel_row])
        r[2] = "-999999"
        rows[sentinel_row] = tuple(r)
    return spark.createDataFrame(rows, "row_id long, constant string, binary01 string, "
                                       "binaryAB string, categorical string, count string, "
                                       "continuous string")


def test_metadata_multimodal(spark):
    spec = P.profile(multimodal(spark), "row_id")
    assert [c.type for c in spec.columns] == ["constant", "binary", "binary", "categorical",
                                              "count", "continuous"]
    assert spec["constant"].zero == "helloworld"
    assert (spec["binary01"].zero, spec["binary01"].one) == ("0", "1")
    assert (spec["binaryAB"].zero, spec["binaryAB"].one) == ("A", "B")
    assert spec["categorical"].unique == ["X", "Y", "Z"]
    assert spec["count"].min == 5 and spec["count"].max == 19
    assert [c.missing for c in spec.columns] == [False] * 6


def test_metadata_missing_flag(spark):
    spec = P.profile(multimodal(spark, sentinel_row=3), "row_id")
    assert [c.missing for c in spec.columns] == [False, True, False, False, False, False]


def test_categorical_unique_keeps_sentinel_and_code_point_order(spark):
    df = one_col(spark, ["x", "Z", "a", "é", "-999999", "x", "Z"])
    spec = P.profile(df, "row_id")
    assert spec["v"].type == "categorical"
    assert spec["v"].unique == ["-999999", "Z", "a", "x", "é"]


def test_high_cardinality_text_guard(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"),
                                  F.concat(F.lit("k"), F.col("id").cast("string")).alias("v"))
    with pytest.raises(ValueError):
        P.profile(df, "row_id", max_categories=100)


def test_high_cardinality_numeric_is_count_or_continuous(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") * 1.0).alias("a"),
                                  (F.col("id") / 7.0).alias("b"))
    spec = P.profile(df, "row_id")
    assert spec["a"].type == "count" and spec["b"].type == "continuous"
    assert spec["a"].max == 4999.0 and math.isclose(spec["b"].max, 4999 / 7.0)


def test_overrides(spark):
    spec = P.profile(one_col(spark, [str(i) for i in range(20)]), "row_id",
                     overrides={"v": "categorical"})
    assert spec["v"].type == "categorical" and len(spec["v"].unique) == 20


def test_typed_columns_are_profiled(spark):
    import datetime
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 20), i % 2 == 0, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, ts timestamp, flag boolean, other boolean")
    types = {c.label: c.type for c in P.profile(df, "row_id").columns}
    assert types == {"ts": "categorical", "flag": "binary", "other": "binary"}


def test_many_numbers_below_max_uniq_are_categories(spark):
    df = spark.createDataFrame([(i, i % 3000) for i in range(6000)], "row_id long, n long")
    assert P.profile(df, "row_id", max_uniq=5000).columns[0].type == "categorical"
    assert P.profile(df, "row_id", max_uniq=10).columns[0].type == "count"
