"""Driver-side column metadata (one entry per input column).

This is the only object the library keeps on the driver. Its size is bounded
by the number of columns (and by ``max_categories`` for category lists),
never by the number of rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CONSTANT, BINARY, CATEGORICAL, COUNT, CONTINUOUS = (
    "constant", "binary", "categorical", "count", "continuous")
MODAL_TYPES = (CONSTANT, BINARY, CATEGORICAL, COUNT, CONTINUOUS)

METADATA_SCHEMA = T.StructType([
    T.StructField("label", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("min", T.DoubleType(), True),
    T.StructField("max", T.DoubleType(), True),
    T.StructField("zero", T.StringType(), True),
    T.StructField("one", T.StringType(), True),
    T.StructField("unique", T.ArrayType(T.StringType()), True),
    T.StructField("missing", T.BooleanType(), False),
    T.StructField("dtype", T.StringType(), False),
])


@dataclass
class ColumnSpec:
    label: str
    pos: int
    type: str
    dtype: str = "string"           # Spark simpleString of the input column
    min: float | None = None
    max: float | None = None
    zero: str | None = None
    one: str | None = None
    unique: list[str] | None = None
    missing: bool = False

    @property
    def numeric_input(self) -> bool:
        return self.dtype not in ("string",)


@dataclass
class Feature:
    """One encoded output column."""
    label: str        # encoded header label, e.g. 'age__age', 'race__2'
    source: str       # input column label
    role: str         # 'value' | 'flag' | 'onehot' | 'missing_onehot'
    index: int = 0    # position inside a one-hot segment


@dataclass
class EncodingSpec:
    columns: list[ColumnSpec]
    sentinel: str = "-999999"
    delim: str = "__"
    meta: dict = field(default_factory=dict)

    # ------------------------------------------------------------------ access
    def __getitem__(self, label: str) -> ColumnSpec:
        for c in self.columns:
            if c.label == label:
                return c
        raise KeyError(label)

    @property
    def labels(self) -> list[str]:
        return [c.label for c in self.columns]

    def has_sentinel_category(self, c: ColumnSpec) -> bool:
        return c.unique is not None and str(self.sentinel) in c.unique

    def features(self, flags: dict[str, bool] | bool = True) -> list[Feature]:
        """Encoded feature list. ``flags`` says per column whether a missing
        indicator (or the extra missing one-hot column) is present."""
        out: list[Feature] = []
        d = self.delim
        for c in self.columns:
            flag = flags if isinstance(flags, bool) else bool(flags.get(c.label, False))
            if c.type == CATEGORICAL:
                uniq = c.unique or []
                for i in range(len(uniq)):
                    out.append(Feature(f"{c.label}{d}{i}", c.label, "onehot", i))
                if flag and not self.has_sentinel_category(c):
                    out.append(Feature(f"{c.label}{d}{len(uniq)}", c.label,
                                       "missing_onehot", len(uniq)))
            elif c.type in (CONSTANT, BINARY, COUNT, CONTINUOUS):
                if flag:
                    out.append(Feature(f"{c.label}{d}{c.label}", c.label, "value"))
                    out.append(Feature(f"{c.label}{d}{self.sentinel}", c.label, "flag"))
                else:
                    out.append(Feature(c.label, c.label, "value"))
            else:
                out.append(Feature(c.label, c.label, "value"))
        return out

    def feature_labels(self, flags: dict[str, bool] | bool = True) -> list[str]:
        return [f.label for f in self.features(flags)]

    # ------------------------------------------------------------ persistence
    def to_json(self) -> str:
        return json.dumps({"columns": [asdict(c) for c in self.columns],
                           "sentinel": self.sentinel, "delim": self.delim,
                           "meta": self.meta})

    @classmethod
    def from_json(cls, text: str) -> "EncodingSpec":
        obj = json.loads(text)
        return cls([ColumnSpec(**c) for c in obj["columns"]], obj["sentinel"],
                   obj["delim"], obj.get("meta", {}))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.label, c.pos, c.type, c.min, c.max, c.zero, c.one,
                 c.unique, bool(c.missing), c.dtype) for c in self.columns]
        return spark.createDataFrame(rows, METADATA_SCHEMA)

    @classmethod
    def from_frame(cls, meta: DataFrame, sentinel="-999999", delim="__") -> "EncodingSpec":
        rows = sorted(meta.collect(), key=lambda r: r["pos"])   # one row per column
        cols = [ColumnSpec(label=r["label"], pos=r["pos"], type=r["type"],
                           dtype=r["dtype"], min=r["min"], max=r["max"],
                           zero=r["zero"], one=r["one"],
                           unique=list(r["unique"]) if r["unique"] is not None else None,
                           missing=r["missing"]) for r in rows]
        return cls(cols, str(sentinel), delim)

    def save(self, spark: SparkSession, path: str) -> None:
        """Persist as Parquet (metadata) plus a one-line JSON sidecar."""
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path + "/metadata")
        spark.createDataFrame([(self.to_json(),)], "spec string") \
            .coalesce(1).write.mode("overwrite").parquet(path + "/spec")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "EncodingSpec":
        text = spark.read.parquet(path + "/spec").first()["spec"]
        return cls.from_json(text)
