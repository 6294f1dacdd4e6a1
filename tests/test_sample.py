"""Sampling and splitting (D1-D5, X2): exact sizes, disjointness and
independence from partitioning."""

from pyspark.sql import functions as F

from tabaudit.operators import sample as D


def keyed(spark, n, parts=8):
    return spark.range(n, numPartitions=parts).select(F.col("id").alias("row_id"))


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


def test_split_exact_size_and_complement(spark):
    df = keyed(spark, 1001)
    tr, te = D.split_exact(df, 0.75, seed=3)
    a, b = ids(tr), ids(te)
    assert len(a) == round(1001 * 0.75)
    assert not set(a) & set(b) and len(a) + len(b) == 1001
    assert ids(D.set_difference(df, tr, "row_id")) == b


def test_split_floor(spark):
    tr, _ = D.split_exact(keyed(spark, 999), 0.8, seed=1, rounding="floor")
    assert tr.count() == int(0.8 * 999)


def test_split_independent_of_partitioning(spark):
    a, _ = D.split_exact(keyed(spark, 5000, 1), 0.3, seed=9)
    b, _ = D.split_exact(keyed(spark, 5000, 8), 0.3, seed=9)
    assert ids(a) == ids(b)


def test_smallest_k_matches_sort(spark):
    from tabaudit.functions.rand import hash_int
    df = keyed(spark, 3000)
    got = ids(D.row_cap(df, 777, seed=5))
    rows = df.select("row_id", hash_int(5, "cap", F.col("row_id")).alias("h")).collect()
    want = sorted(r["row_id"] for r in sorted(rows, key=lambda r: (r["h"], r["row_id"]))[:777])
    assert got == want


def test_row_cap_no_op_when_small(spark):
    assert D.row_cap(keyed(spark, 50), 100).count() == 50


def test_split_proportional(spark):
    tr, te = D.split_proportional(keyed(spark, 400), 300, 100)
    assert tr.count() == 300 and te.count() == 100


def test_bootstrap_deterministic_and_sized(spark):
    a = D.bootstrap(keyed(spark, 20000, 1), seed=2)
    b = D.bootstrap(keyed(spark, 20000, 8), seed=2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    n = a.count()
    assert n == 20000
    # multiplicities follow Poisson(1): share of rows drawn zero times ~ e^-1
    drawn = a.select("row_id").distinct().count()
    assert abs((20000 - drawn) / 20000 - 0.3679) < 0.02
