"""Dictionaries of any size and sparse encoding; orders over keys of any type."""

import pytest
from pyspark.sql import functions as F

from tabaudit.operators import sparse as S
from tabaudit.operators.pivots import nearest_by_kind
from tabaudit.operators.prefix import row_index
from tabaudit.operators.sample import bootstrap


def test_many_categories_encode_and_restore(spark):
    """120,000 values of a column; every third row has the same one."""
    df = spark.range(180_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("code"),
                                     (F.col("id") % 50).cast("double").alias("count"))
    spec = S.sparse_spec(df)
    assert spec.types == {"code": "categorical", "count": "count"} and spec.width == 120_001 + 2
    entries = S.encode_sparse(df, spec)
    assert entries.where("label = 'code'").agg(F.count("*"), F.sum("value")).first()[0] == 180_000
    back = S.decode_sparse(entries, spec, df)
    same = back.join(df.withColumnsRenamed({"code": "c", "count": "k"}), "row_id").where("code <=> c AND count <=> k").count()
    assert same == 180_000


def test_missing_unseen_and_ties(spark):
    rows = [(i, ["b", "a", None, "-999999", ""][i % 5], [1.5 * i, None][i % 7 == 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, code string, x double")
    spec = S.sparse_spec(df, overrides={"x": "continuous"})
    back = {r["row_id"]: (r["code"], r["x"]) for r in S.decode_sparse(S.encode_sparse(df, spec), spec, df).collect()}
    for i, code, x in rows:
        assert back[i][0] == ("-999999" if code is None else code)
        assert back[i][1] == pytest.approx(-999999.0 if x is None else x)
    unseen = spark.createDataFrame([(1, "new", 2.0)], "row_id long, code string, x double")
    assert S.encode_sparse(unseen, spec).where("label = 'code'").count() == 0
    assert S.decode_sparse(S.encode_sparse(unseen, spec), spec, unseen).first()["code"] is None
    tied = spark.createDataFrame([(1, "code", 2, 0.5), (1, "code", 1, 0.5), (1, "code", 3, 0.1)], "row_id long, label string, pos long, value double")
    value = {r["pos"]: r["value"] for r in spec.dictionary.where("label = 'code'").collect()}
    assert S.decode_sparse(tied, spec, tied.select("row_id").distinct()).first()["code"] == value[1]


def test_text_keys_have_an_order_at_any_size(spark):
    df = spark.range(0, 210_000, 1, 7).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("row_id"), "id")
    assert row_index(df, "row_id").where(F.col("idx") != F.col("id") + 1).isEmpty()
    assert bootstrap(df, "row_id").count() == 210_000


def test_all_tables_are_searched_at_once(spark):
    rows = spark.createDataFrame([(i, [float(i % 10), 0.0]) for i in range(40)] + [(99, [50.0, 0.0])], "id long, v array<double>")
    near = spark.createDataFrame([([float(i) + 0.25, 0.0],) for i in range(12)], "v array<double>")
    none = near.limit(0)
    out = {(r["id"], r["kind"]): r["dist"] for r in nearest_by_kind(rows, {"near": near, "none": none}, "own", block_rows=4).collect()}
    assert all(out[i, "own"] == 0.0 and out[i, "none"] is None for i in range(40)) and out[99, "own"] == 41.0
    assert all(out[i, "near"] == 0.25 for i in range(40)) and out[99, "near"] == 38.75


def test_row_numbers_do_not_depend_on_blocks(spark, tmp_path):
    from tabaudit.sources.files import read_table, write_table
    path = str(tmp_path / "keyless.csv")
    write_table(spark.range(5000).select(F.col("id"), F.concat(F.lit("x"), F.col("id")).alias("x")).repartitionByRange(3, "id").sortWithinPartitions("id"), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("1k", "7k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = read_table(spark, path, row_id="line")
            seen.append(sorted((r["line"], r["id"], r["x"]) for r in back.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == seen[2] == [(i, str(i), f"x{i}") for i in range(5000)]


def test_tree_keeps_dependence_without_order(spark):
    """A nominal pair whose dependence no order of the categories shows."""
    from tabaudit.operators import tree as T
    import random
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        a = rng.choice("abc")
        b = {"a": "x", "b": "y", "c": "x"}[a] if rng.random() < 0.9 else rng.choice("xy")
        rows.append((i, a, b, rng.choice([None, float(rng.randrange(100)) + (500 if b == "y" else 0)])))
    df = spark.createDataFrame(rows, "row_id long, a string, b string, v double")
    model = T.fit_tree(df)
    assert dict(model.order)["b"] == "a" or dict(model.order)["v"] == "b"
    gen = T.sample_tree(spark, model, 4000, seed=1)
    share = {(r["a"], r["b"]): r["n"] / 4000 for r in gen.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    real = {(r["a"], r["b"]): r["n"] / 4000 for r in df.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share.get(k, 0) - x) < 0.03 for k, x in real.items())
    low = gen.where("b = 'x' AND v <> -999999").agg(F.avg("v")).first()[0]
    high = gen.where("b = 'y' AND v <> -999999").agg(F.avg("v")).first()[0]
    assert high - low > 400 and 0.4 < gen.where("v = -999999").count() / 4000 < 0.6
