"""Session helpers: building a local session for tests/bench, shared scratch
locations and lineage cuts.

On a cluster the session is created by the caller; this module only reads
``spark.checkpoint.dir`` from it. A directory is set only when none is
configured (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one BLAS thread per Python worker: tasks already occupy every core
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabaudit", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, setting one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # tests and local runs in one process
        configured = tempfile.mkdtemp(prefix="tabaudit-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint directory (never machine-local
    on a cluster, because the checkpoint dir is shared storage there)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tabaudit", f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor
    loss, unlike local checkpoints)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over at least four partitions a core, for work
    a row that is heavy beside its bytes; the number of input splits goes by
    bytes. No adaptive coalescing, which goes by bytes as well."""
    n = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(n, key)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabaudit`` importable in the Python workers of this session.

    Closures sent to mapInPandas / applyInPandas refer to package functions
    by module, so workers must be able to import the package. The package is
    zipped on the driver and distributed with ``SparkContext.addPyFile``
    (Spark ships the file; executors never read the driver's disk). Done once
    per SparkContext."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="tabaudit-pyfiles-")
    path = os.path.join(out_dir, "tabaudit.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
