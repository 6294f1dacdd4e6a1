"""Encoding / decoding (E1-E10), including the reference's literal cases and
the encode -> restore round trip."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.operators import encode as E
from tabaudit.operators import profile as P
from tests.test_profile import multimodal, one_col


def hot_rows(spark, values, unique, add_missing):
    df = one_col(spark, values)
    seg = E.one_hot(F.col("v"), T.StringType(), unique, add_missing_col=add_missing)
    return [list(r[0]) for r in df.orderBy("row_id").select(seg).collect()]


def test_one_hot_basic(spark):
    assert hot_rows(spark, ["Y", "X", "X", "Z", "Y"], ["X", "Y", "Z"], False) == \
        [[0, 1, 0], [1, 0, 0], [1, 0, 0], [0, 0, 1], [0, 1, 0]]


def test_one_hot_sentinel_already_a_category(spark):
    uniq = sorted(["Y", "X", "-999999"])
    assert hot_rows(spark, ["Y", "X", "X", "-999999", "Y"], uniq, True) == \
        [[0, 0, 1], [0, 1, 0], [0, 1, 0], [1, 0, 0], [0, 0, 1]]


def test_one_hot_unseen_and_extra_missing_column(spark):
    assert hot_rows(spark, ["X", "W", "-999999"], ["X", "Y"], True) == \
        [[1, 0, 0], [0, 0, 0], [0, 0, 1]]


def test_one_hot_wide_dictionary(spark):
    uniq = [f"v{i:03d}" for i in range(100)]
    rows = hot_rows(spark, ["v007", "v099"], uniq, False)
    assert rows[0].index(1.0) == 7 and rows[1].index(1.0) == 99 and sum(rows[0]) == 1


def test_scale_and_unscale(spark):
    df = one_col(spark, [float(i) for i in range(11)], "double")
    s = [r["v"] for r in E.min_max_scale(df, ["v"]).orderBy("row_id").collect()]
    assert [round(v, 10) for v in s] == [i / 10 for i in range(11)]
    back = df.select(E.unscale(F.lit(0.3), 0.0, 10.0).alias("u")).first()["u"]
    assert math.isclose(back, 3.0)


def test_scale_keeps_sentinel(spark):
    df = one_col(spark, [0.0, -999999.0, 10.0], "double")
    s = [r["v"] for r in E.min_max_scale(df, ["v"]).orderBy("row_id").collect()]
    assert s == [0.0, -999999.0, 1.0]


def test_vector_scale_invert(spark):
    df = one_col(spark, [1.0, 2.0, 3.0], "double")
    s = [r["v"] for r in E.vector_scale(df, "v", invert=True).orderBy("row_id").collect()]
    assert s == [1.0, 0.5, 0.0]


def test_encoded_width(spark):
    df = multimodal(spark)
    spec = P.profile(df, "row_id")
    assert len(E.encode(df, spec, "row_id", require_missing=False).features) == 8
    assert len(E.encode(df, spec, "row_id", require_missing=True).features) == 14


def test_argmax_decode(spark):
    rows = [(0, [0.1, 0.2, 0.9]), (1, [0.0, 0.0, 1.0]), (2, [0.2, 0.7, 0.1]),
            (3, [0.8, 0.1, 0.1]), (4, [0.3, 0.6, 0.1]), (5, [0.5, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, s array<double>")
    out = [r[0] for r in df.orderBy("row_id").select(
        E.argmax_decode(F.col("s"), ["val1", "val2", "val3"])).collect()]
    assert out == ["val3", "val3", "val2", "val1", "val2", "val1"]   # tie -> first


def test_round_trip_multimodal(spark):
    df = multimodal(spark)
    spec = P.profile(df, "row_id")
    enc = E.encode(df, spec, "row_id", scale_by="spec")
    out = {r["row_id"]: r for r in E.decode(enc).collect()}
    for r in df.collect():
        o = out[r["row_id"]]
        for c in ("constant", "binary01", "binaryAB", "categorical"):
            assert o[c] == r[c]
        assert float(o["count"]) == float(r["count"])
        assert abs(float(o["continuous"]) - float(r["continuous"])) < 1e-5


def test_round_trip_text_binary(spark):
    df = spark.createDataFrame([(0, "0", "1"), (1, "1", "1"), (2, "0", "0"), (3, "1", "0"), (4, "0", "0")],
                               "row_id long, col1 string, col2 string")
    spec = P.profile(df, "row_id")
    out = E.decode(E.encode(df, spec, "row_id")).orderBy("row_id").collect()
    assert [(r["col1"], r["col2"]) for r in out] == [(r["col1"], r["col2"]) for r in df.orderBy("row_id").collect()]


def test_round_trip_missing(spark):
    df = multimodal(spark, sentinel_row=5)
    spec = P.profile(df, "row_id")
    out = {r["row_id"]: r for r in E.decode(E.encode(df, spec, "row_id")).collect()}
    assert out[5]["binary01"] == "-999999"


def test_decode_count_half_even_and_binary_half(spark):
    df = one_col(spark, [str(i) for i in range(20)])
    spec = P.profile(df, "row_id")
    assert spec["v"].type == "count"
    enc = E.Encoded(spark.createDataFrame([(0, [0.5 / 19, 0.0]), (1, [2.5 / 19, 0.0])],
                                          "row_id long, x array<double>"),
                    spec.features(True), spec)
    vals = [r["v"] for r in E.decode(enc).orderBy("row_id").collect()]
    assert vals == ["0.0", "2.0"]      # 0.5 -> 0 and 2.5 -> 2 (half to even)


def test_clip(spark):
    df = spark.createDataFrame([([-0.5, 0.3, 1.7],)], "x array<double>")
    assert df.select(E.clip01(F.col("x"))).first()[0] == [0.0, 0.3, 1.0]


def test_split_outcome_keeps_missing_flag(spark):
    df = multimodal(spark)
    spec = P.profile(df, "row_id")
    enc = E.encode(df, spec, "row_id")
    xy, feats = E.split_outcome(enc, "binaryAB")
    labels = [f.label for f in feats]
    assert "binaryAB__binaryAB" not in labels and "binaryAB__-999999" in labels
    assert xy.filter(F.col("y") == 1).count() == 1


def test_group_encoding_matches_separate(spark):
    df = multimodal(spark)
    spec = P.profile(df, "row_id")
    a = df.filter("row_id < 100")
    b = df.filter("row_id >= 100")
    stacked = a.withColumn("g", F.lit("a")).unionByName(b.withColumn("g", F.lit("b")))
    st = E.encode(stacked, spec, "row_id", group_col="g")
    sep = {r["row_id"]: r["x"] for r in E.encode(b, spec, "row_id").df.collect()}
    for r in st.df.filter("g = 'b'").collect():
        assert r["x"] == sep[r["row_id"]]


def test_one_hot_wide_matches_narrow_rule(spark):
    uniq = [f"c{i:04d}" for i in range(300)]
    vals = ["c0000", "c0150", "c0299", "zzz", "c0042"]
    rows = hot_rows(spark, vals, uniq, True)
    for v, r in zip(vals, rows):
        assert len(r) == 301
        want = [1.0 if u == v else 0.0 for u in uniq] + [0.0]
        assert r == want
