"""Structured Streaming use of the encoder.

With a fitted spec and ``scale_by='spec'`` the encoding (E6) is a pure
per-row projection, so it runs unchanged on a streaming DataFrame. A running
feature frequency (R1) is then an ordinary streaming aggregate (state is
d partial sums per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.operators.encode import Encoded, encode
from tabaudit.spec import EncodingSpec


def encode_stream(stream: DataFrame, spec: EncodingSpec, row_id: str = "row_id",
                  seed: int = 0) -> Encoded:
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return encode(stream, spec, row_id, require_missing=True, seed=seed, scale_by="spec")


def running_frequency(enc: Encoded, group_col: str | None = None) -> DataFrame:
    """Streaming mean of every encoded feature (optionally per group);
    use outputMode('complete') or ('update')."""
    x = F.col("x")
    aggs = [F.avg(x[i]).alias(f.label) for i, f in enumerate(enc.features)]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    if group_col:
        return enc.df.groupBy(group_col).agg(*aggs)
    return enc.df.agg(*aggs)
