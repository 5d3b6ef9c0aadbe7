"""Vectors as arrays of float; sums are in double precision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, floor: float = 1e-12) -> Column:
    """Divided by its length, or by ``floor`` if that is greater."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each of the query's vectors its best match among the document's, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


MAGIC = b"VF32"


def decode_blob(blob: bytes) -> list[float]:
    """Little-endian floats after four signs that say so."""
    import struct

    if blob[:4] != MAGIC or len(blob) % 4:
        raise ValueError("not a blob of 32-bit floats")
    return list(struct.unpack(f"<{len(blob) // 4 - 1}f", blob[4:]))


def blob_vector(blob: Column) -> Column:
    """Array of float from such blobs."""
    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decode_blob(bytes(b)))

    return decode(blob)
