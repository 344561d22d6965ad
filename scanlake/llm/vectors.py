"""What the two vector operators share: valid rows of an embeddings table, as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector as little-endian float64 bytes) of rows with an id and a vector without null and non-finite components.

    Of rows that repeat a vec_id, the smallest vector (in Spark's order of arrays) counts.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])

    def packed(batches):
        for batch in batches:
            column = batch.column(1)
            flat = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype="<f8")
            ends = column.offsets.to_numpy()
            yield batch_of(schema, batch.column(0), [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = rows.filter(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.mapInArrow(packed, "vec_id long, vector binary")


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Rows of float64; shorter vectors are padded with zeros."""
    width = max((len(v) // 8 for v in vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, dtype="<f8")
    return out
