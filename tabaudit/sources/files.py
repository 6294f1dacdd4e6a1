"""Table sources and sinks.

* ``file_type`` / ``read_table``: dispatch on the suffix (csv, tsv, parquet,
  feather, npy). CSV/TSV are read all-string like the reference (an empty
  cell stays ''), and a leading '# ' is stripped from the first label.
* Feather (Arrow IPC) is read by a Python ``DataSource`` with one input
  partition per file, so many files are read in parallel by executors.
* ``.npy`` matrices are read with ``mapInPandas`` over a file-list frame
  (one task per file group, in bounded pieces); object arrays are refused (no pickle).
* ``write_table`` writes a directory of CSV parts with a plain header.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a matrix that a task writes or reads at a time.
NPY_CELLS = 1 << 18

SUFFIXES = (("npy", ".npy"), ("feather", ".feather"), ("csv", ".csv"), ("tsv", ".tsv"),
            ("parquet", ".parquet"))


def file_type(name: str) -> str | None:
    """Standardised suffix, or None for anything else."""
    for kind, suffix in SUFFIXES:
        if name.endswith(suffix):
            return kind
    return None


def default_header(n_col: int, prefix: str = "C") -> list[str]:
    """C0..C{n-1}, zero padded to the width of n-1."""
    width = len(str(n_col - 1))
    return [f"{prefix}{str(i).zfill(width)}" for i in range(n_col)]


def with_default_header(df: DataFrame, prefix: str = "C") -> DataFrame:
    return df.toDF(*default_header(len(df.columns), prefix))


def _expand(path: str) -> list[str]:
    path = path[len("file:"):] if path.startswith("file:") else path
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "*")))
    return sorted(glob.glob(path)) or [path]


def _numbered(scan: DataFrame, name: str) -> DataFrame:
    """``scan``, straight from files, with the number (from 0) that a reader of
    all files in the order of their names and lines would give a row. Rows are
    numbered within the block of a file that a task reads, and blocks by one
    count each, so the numbers are the same whatever the blocks, and retries
    give them again."""
    read = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_at"))
    blocks = read.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)     # one row a block
    blocks = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return read.join(blocks, ["_file", "_block"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_file", "_block", "_at", "_shift")


def read_csv(spark: SparkSession, path: str, sep: str = ",", has_header: bool = True, row_id: str | None = None) -> DataFrame:
    """All-string read; '' stays '' (not NULL); '# ' stripped from the
    first header label. ``row_id`` names an added column for files without a
    key: the row's number over all files."""
    reader = (spark.read.option("sep", sep).option("header", has_header)
              .option("nullValue", None).option("emptyValue", "")
              .option("inferSchema", False).option("mode", "FAILFAST"))
    df = reader.csv(path)
    if has_header:
        first = df.columns[0]
        if first.startswith("# "):
            df = df.withColumnRenamed(first, first[2:])
        elif first.startswith("#"):
            df = df.withColumnRenamed(first, first[1:].lstrip())
    else:
        df = with_default_header(df)
    labels = df.columns
    kept = []
    if row_id is not None:
        df, kept = _numbered(df, row_id), [row_id]
    return df.select(*kept, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in labels])


def read_table(spark: SparkSession, path: str, has_header: bool = True,
               fmt: str | None = None, row_id: str | None = None) -> DataFrame:
    """Read any supported format; unknown suffix or missing path
    raises (the reference returns None)."""
    fmt = fmt or file_type(path.rstrip("/"))
    if fmt is None and os.path.isdir(path):
        kinds = {file_type(p) for p in _expand(path)} - {None}
        fmt = kinds.pop() if len(kinds) == 1 else None
    if fmt is None:
        raise ValueError(f"unsupported file type: {path}")
    local = path[len("file:"):] if path.startswith("file:") else path
    if "://" not in local and not glob.glob(local):
        raise FileNotFoundError(path)
    if fmt in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if fmt == "tsv" else ",", has_header, row_id)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "feather":
        register_feather(spark)
        return spark.read.format("feather").load(path)
    if fmt == "npy":
        return read_npy(spark, [p for p in _expand(path) if p.endswith(".npy")], has_header)
    raise ValueError(fmt)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Directory of CSV parts, header without a comment mark."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


# ----------------------------------------------------------------- feather
_FEATHER_REGISTERED = False


def register_feather(spark: SparkSession) -> None:
    global _FEATHER_REGISTERED
    if _FEATHER_REGISTERED:
        return
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class _FilePartition(InputPartition):
        def __init__(self, path):
            self.path = path

    class _Reader(DataSourceReader):
        def __init__(self, paths):
            self.paths = paths

        def partitions(self):
            return [_FilePartition(p) for p in self.paths]

        def read(self, partition):
            import pyarrow.feather as feather
            table = feather.read_table(partition.path)
            for batch in table.to_batches():
                yield batch

    class FeatherSource(DataSource):
        @classmethod
        def name(cls):
            return "feather"

        def _paths(self):
            p = self.options["path"]
            p = p[len("file:"):] if p.startswith("file:") else p
            return [f for f in _expand(p) if f.endswith(".feather")]

        def schema(self):
            import pyarrow.feather as feather
            from pyspark.sql.pandas.types import from_arrow_schema
            return from_arrow_schema(feather.read_table(self._paths()[0]).schema)

        def reader(self, schema):
            return _Reader(self._paths())

    spark.dataSource.register(FeatherSource)
    _FEATHER_REGISTERED = True


# --------------------------------------------------------------------- npy
def read_npy(spark: SparkSession, paths: list[str], has_header: bool = True) -> DataFrame:
    """S3: 2-D .npy matrices, first row as header when ``has_header``.
    Values come back as strings (one homogeneous dtype per file)."""
    import numpy as np
    first = np.load(paths[0], mmap_mode="r", allow_pickle=False)
    if first.ndim != 2:
        raise ValueError("expected a 2-D matrix")
    header = [str(v) for v in first[0]] if has_header else default_header(first.shape[1])
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))

    def load(it):
        import numpy as np
        import pandas as pd
        for pdf in it:
            for p in pdf["path"]:
                m = np.load(p, mmap_mode="r", allow_pickle=False)
                step = max(1, NPY_CELLS // max(1, m.shape[1]))
                for a in range(int(has_header), len(m), step):     # a file of any size in bounded pieces
                    yield pd.DataFrame(np.asarray(m[a:a + step]).astype(str), columns=header)

    return files.mapInPandas(load, schema)


def write_feather(df: DataFrame, path: str) -> list[str]:
    """Write one Feather (Arrow IPC) file per partition, by the executors,
    into ``path`` (shared storage). Returns the file names (one per
    partition, so bounded by the partition count)."""
    import uuid

    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    run = uuid.uuid4().hex

    def write(batches):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.feather as feather
        from pyspark import TaskContext
        ctx = TaskContext.get()
        tables = [pa.Table.from_pandas(b, preserve_index=False) for b in batches]
        if tables:
            name = os.path.join(local, f"part-{ctx.partitionId():05d}-{ctx.attemptNumber()}-{run}.feather")
            tmp = name + ".tmp"
            feather.write_feather(pa.concat_tables(tables), tmp)
            os.replace(tmp, name)        # a retried task overwrites nothing half-written
            yield pd.DataFrame({"file": [name]})

    files = [r["file"] for r in df.mapInPandas(write, "file string").collect()]
    return files


def write_npy(df: DataFrame, path: str, with_header: bool = True) -> list[str]:
    """Write 2-D string ``.npy`` matrices (header as the first row when
    ``with_header``) of at most NPY_CELLS cells, by the executors, into
    ``path``: a task holds one matrix, whatever the size of its partition."""
    import uuid

    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    run = uuid.uuid4().hex
    header = list(df.columns)
    most = max(1, NPY_CELLS // max(1, len(header)))

    def write(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext
        ctx = TaskContext.get()
        top = [np.array(header, dtype=str)[None, :]] if with_header else []
        parts: list = []
        held = made = 0

        def save():
            nonlocal parts, held, made
            name = os.path.join(local, f"part-{ctx.partitionId():05d}-{made:05d}-{ctx.attemptNumber()}-{run}.npy")
            tmp = name + ".tmp.npy"
            np.save(tmp, np.vstack([*top, *parts]).astype(str), allow_pickle=False)
            os.replace(tmp, name)
            parts, held, made = [], 0, made + 1
            return pd.DataFrame({"file": [name]})

        for b in batches:
            for a in range(0, len(b), most):
                piece = b.iloc[a:a + most]
                if held and held + len(piece) > most:
                    yield save()
                parts.append(piece.astype(str).to_numpy())
                held += len(piece)
        if held:
            yield save()

    return [r["file"] for r in df.mapInPandas(write, "file string").collect()]
