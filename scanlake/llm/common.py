"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.sources.work import new_folder

#: Rows that a worker turns into Python objects at a time.
ROWS = 256
#: Rows with texts that Spark hands to a worker at once, at most. Its own bound, 10,000, takes over 60 MB a column for texts of some 3 KB, in the executor and in the worker.
BATCH = 4096
#: Entries that a worker's cache may hold; a full cache is emptied.
CACHE = 1 << 18


def written(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here and any executor can reread it.

    folders: columns by whose values the files are kept apart, so that a filter on them reads no other files.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` gave, once nothing that is still to be computed reads them."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, rows: int = ROWS):
    """Cut Arrow batches into pieces of at most so many rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands at most BATCH rows to a worker at once; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, BATCH)
    return df


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns, and the text as UTF-8 bytes (null stays null); other columns are not read."""
    return in_batches(df).select(*columns, F.col("text").cast("binary").alias("text"))


def with_texts(df: DataFrame, row: Column, keep: tuple[str, ...]) -> DataFrame:
    """row (a column that holds the columns named in keep), and the text, unless row holds it: a text goes to a worker once."""
    return in_batches(df).select(row, *([] if "text" in keep else ["text"]))


def text_of(batch: pa.RecordBatch, *path: str) -> pa.Array:
    """The texts of a batch of `with_texts`; path: where its first column has them if they are no column of their own."""
    if batch.num_columns > 1:
        return batch.column(1)
    found = batch.column(0)
    for name in (*path, "text"):
        found = found.field(name)
    return found


class WordHash(dict):
    """Word (bytes) to a 64-bit hash; remembers words, up to CACHE of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_hash(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes (none if there are fewer words)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    out = np.full(len(h) - n + 1, seed + 1, dtype=np.uint64)
    for i in range(n):
        out = out * factor + h[i : i + len(out)]
    return mix(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
