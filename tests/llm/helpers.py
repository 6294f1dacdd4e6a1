"""Small inputs with the awkward rows that every operator must take."""

import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts, first=0):
    return [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def docs(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def clashing(df, *names):
    """Extra columns named like outputs or inner columns."""
    from pyspark.sql import functions as F
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def crc(ids):
    import numpy as np
    return zlib.crc32(np.array(ids, "<u4").tobytes())
