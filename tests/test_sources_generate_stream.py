"""Sources (S1-S8), generators (G1-G5), streaming encode and the driver
contract."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabaudit.operators import encode as E
from tabaudit.operators import generate as G
from tabaudit.operators import profile as P
from tabaudit.sources import files as S
from tests.conftest import SF001
from tests.test_profile import multimodal


@pytest.mark.parametrize("name", ["file.pdf", "test.npy.pdf", "feather.myfeather", "mycsv.txt",
                                  "test.tsv.tsv.not", "test.csvcsv"])
def test_file_type_none(name):
    assert S.file_type(name) is None


def test_file_type_known():
    assert [S.file_type(n) for n in ("a.npy", "a.feather", "a.csv", "a.tsv")] == \
        ["npy", "feather", "csv", "tsv"]


def test_default_header():
    assert S.default_header(5) == ["C0", "C1", "C2", "C3", "C4"]
    assert S.default_header(11)[:2] == ["C00", "C01"]


def test_csv_comment_header_and_empty_cells(spark):
    d = tempfile.mkdtemp(prefix="tabaudit-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as fh:
        fh.write("# a,b\n1,\n2,x\n")
    df = S.read_table(spark, p)
    assert df.columns == ["a", "b"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", ""), ("2", "x")]
    t = os.path.join(d, "t.tsv")
    with open(t, "w") as fh:
        fh.write("a\tb\n1\t2\n")
    assert S.read_table(spark, t).first()["b"] == "2"


def test_read_missing_or_unknown(spark):
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, "/nonexistent/x.csv")
    with pytest.raises(ValueError):
        S.read_table(spark, "/tmp/x.pdf")


def test_feather_source_one_partition_per_file(spark):
    d = tempfile.mkdtemp(prefix="tabaudit-feather-")
    for k in range(3):
        pd.DataFrame({"a": [k * 10 + i for i in range(5)], "b": ["x"] * 5}).to_feather(
            os.path.join(d, f"p{k}.feather"))
    df = S.read_table(spark, d, fmt="feather")
    assert df.count() == 15 and df.rdd.getNumPartitions() == 3


def test_npy_with_header(spark):
    d = tempfile.mkdtemp(prefix="tabaudit-npy-")
    m = np.array([["h1", "h2"], ["1", "2"], ["3", "4"]])
    p = os.path.join(d, "m.npy")
    np.save(p, m)
    df = S.read_table(spark, p)
    assert df.columns == ["h1", "h2"] and sorted(r["h1"] for r in df.collect()) == ["1", "3"]


def test_csv_round_trip(spark):
    from tabaudit.session import scratch_path
    df = multimodal(spark, 30)
    path = scratch_path(spark, "rt") + ".csv"
    S.write_table(df, path)
    back = S.read_table(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == \
        sorted(tuple(str(v) for v in r) for r in df.collect())


def test_spec_save_load(spark):
    from tabaudit.session import scratch_path
    from tabaudit.spec import EncodingSpec
    spec = P.profile(multimodal(spark), "row_id")
    path = scratch_path(spark, "spec")
    spec.save(spark, path)
    assert EncodingSpec.load(spark, path).to_json() == spec.to_json()


def test_marginal_and_uniform_bits(spark):
    df = multimodal(spark, 400)
    enc = E.encode(df, P.profile(df, "row_id"), "row_id")
    g1 = G.marginal_sample(enc, seed=1)
    means = G.feature_means(enc)
    got = G.feature_means(g1)
    assert all(abs(a - b) < 0.1 for a, b in zip(means, got))
    g2 = G.uniform_bits(enc, seed=1)
    assert abs(np.mean(G.feature_means(g2)) - 0.5) < 0.05


def test_copula_generates_n_rows_in_unit_box(spark):
    df = multimodal(spark, 300)
    spec = P.profile(df, "row_id")
    enc = E.encode(df, spec, "row_id")
    model = G.fit_copula(enc)
    a = G.sample_copula(spark, model, 500, seed=3, num_partitions=1)
    b = G.sample_copula(spark, model, 500, seed=3, num_partitions=7)
    ra = {r["row_id"]: r["x"] for r in a.collect()}
    rb = {r["row_id"]: r["x"] for r in b.collect()}
    assert len(ra) == 500 and ra == rb
    assert all(0.0 <= v <= 1.0 for x in ra.values() for v in x)
    restored = E.decode(enc.with_df(a))
    assert restored.count() == 500 and set(restored.columns) == set(df.columns)


def test_copula_keeps_the_shares_of_the_table(spark):
    rows = [(i, "XYZ"[(i * 7) % 10 // 4], "-999999" if i % 250 == 0 else float(i % 97), "B" if i % 5 == 0 else "A") for i in range(4000)]
    df = spark.createDataFrame([(i, c, str(n), b) for i, c, n, b in rows], "row_id long, c string, n string, b string")
    spec = P.profile(df, "row_id")
    enc = E.encode(df, spec, "row_id")
    gen = E.decode(enc.with_df(G.sample_copula(spark, G.fit_copula(enc), 20000, seed=5)))
    for col in ("c", "b"):
        want = {r[col]: r["count"] / 4000 for r in df.groupBy(col).count().collect()}
        got = {r[col]: r["count"] / 20000 for r in gen.groupBy(col).count().collect()}
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 0.02 for k in want)
    missing = gen.where("n = '-999999'").count()
    assert 40 <= missing <= 140      # 0.4 % of the rows


def test_streaming_encode_matches_batch(spark):
    from tabaudit.streaming.encode_stream import encode_stream, running_frequency
    df = multimodal(spark, 100)
    spec = P.profile(df, "row_id")
    d = tempfile.mkdtemp(prefix="tabaudit-stream-")
    df.write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))
    enc = encode_stream(stream, spec)
    q = (running_frequency(enc).writeStream.outputMode("complete").format("memory")
         .queryName("tabaudit_freq").option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM tabaudit_freq").first()
    batch = G.feature_means(E.encode(df, spec, "row_id", scale_by="spec"))
    assert got["n_rows"] == 100
    assert all(abs(got[f.label] - m) < 1e-12 for f, m in zip(enc.features, batch))


def test_entry_and_registry(spark):
    import __spark_entry__ as ent
    out = ent.entry(spark)
    assert out.count() > 0 and out.columns == ["feature", "real_train", "real_test", "synth"]
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


@pytest.mark.parametrize("name", ["profile_metadata", "split_exact", "auc", "memorization"])
def test_queries_run_on_smoke_data(spark, name):
    import __spark_entry__ as ent
    assert ent.queries()[name](spark, SF001).count() > 0


def test_user_generator_protocol(spark):
    class Half(G.Generator):
        def fit(self, enc):
            return len(enc.features)

        def sample_batch(self, model, ids, seed):
            return np.full((len(ids), model), 0.5)

    df = multimodal(spark, 50)
    enc = E.encode(df, P.profile(df, "row_id"), "row_id")
    g = Half()
    out = g.generate(spark, g.fit(enc), 20)
    assert out.count() == 20 and all(v == 0.5 for r in out.collect() for v in r["x"])
    cop = G.CopulaGenerator("marginal")
    assert cop.generate(spark, cop.fit(enc), 10).count() == 10


def test_npy_matrices_are_bounded(spark, monkeypatch):
    """A partition of many rows is several matrices, and they hold every row once."""
    import numpy as np
    monkeypatch.setattr(S, "NPY_CELLS", 40)
    d = tempfile.mkdtemp(prefix="tabaudit-npy-")
    df = spark.range(0, 95, 1, 1).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    files = S.write_npy(df, d)
    assert len(files) == 5 and all(len(np.load(f)) <= 21 for f in files)
    got = S.read_table(spark, d, fmt="npy")
    assert sorted((int(r["k"]), r["v"]) for r in got.collect()) == [(i, f"v{i}") for i in range(95)]


def test_tree_draws_once_a_row(spark):
    """No hash is inside the function that a row's shares are compared by."""
    from tabaudit.operators import tree as T
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(30)], "row_id long, p string, q string")
    out = T.sample_tree(spark, T.fit_tree(df), 40, seed=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    steps = plan.split("lambdafunction(")[1:]
    assert len(steps) >= 2 and not any("md5(" in s.split(" AS ")[0] for s in steps)
    assert out.count() == 40 and {r["q"] for r in out.collect()} == {"x", "y", "z"}
