"""Pieces that the operators of this subpackage share: texts, vectors, Arrow columns, checkpoints."""

from __future__ import annotations

import gc
import threading
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.saved import saved

#: Components of a valid vector (fixed by the data).
DIM = 64
NOT_WORD = r"[^\p{L}\p{N}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: later stages, and a retry after a lost executor, read them from there."""
    return saved(df)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files behind results that were cut and whose plans are no longer held.

    It does so once the driver's garbage is collected, which may be long after the disks of the executors are full. Plans
    that Python has let go reach the JVM a little later, so a thread waits for that while the work goes on."""
    gc.collect()

    def collect() -> None:
        for _ in range(2):
            time.sleep(1.2)
            try:
                spark.sparkContext._jvm.System.gc()
            except Exception:  # noqa: BLE001
                return  # the session has ended

    threading.Thread(target=collect, daemon=True).start()


# ---- texts


def words(text: Column) -> Column:
    """array<string>: maximal runs of letters or digits of the lower-cased text; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def is_blank(text: Column) -> Column:
    """True for null and for texts without any letter or digit."""
    return F.coalesce(~text.rlike(r"[\p{L}\p{N}]"), F.lit(True))


def canonical(text: Column) -> Column:
    """The bytes that equal chunks share: fields between `|`, lower-cased, letters and digits only, empty ones dropped, in sorted order.

    A null or blank text gives "". A text without `|` is one field."""
    fields = F.transform(F.split(F.lower(text), r"\|"), lambda f: F.regexp_replace(f, NOT_WORD, ""))
    return F.concat_ws("|", F.array_sort(F.filter(fields, lambda f: f != "")))


# ---- vectors


def is_valid(vector: Column) -> Column:
    """Not null, DIM components, all finite, not all zero. A null component makes a vector invalid."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == DIM) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.Array) -> np.ndarray:
    """float32 [rows, components] of an array<float> column without nulls, or of a binary one; all rows have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 1), np.float32)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2], np.float32, count=(offsets[-1] - offsets[0]) // 4, offset=offsets[0])
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, reckoned in double, as float32."""
    y = x.astype(np.float64)
    # Scaling by the largest component first keeps the squares of huge and tiny components finite.
    y /= np.abs(y).max(axis=1, keepdims=True, initial=1e-300)
    y /= np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)
    return y.astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double, from the stored components."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def binary_of(x: np.ndarray) -> pa.Array:
    """One binary value for each row."""
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * step, step, dtype=np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each integer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


# ---- Arrow batches


def by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of their groups, for batches in which groups stand together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy()
        change = np.nonzero(v[1:] != v[:-1])[0]
        last = int(change[-1]) + 1 if len(change) else 0
        first = held and held[-1].column(column)[-1].as_py() != v[0]
        if first or last:
            if not first:
                held.append(b.slice(0, last))
                b = b.slice(last)
            elif last:
                held.append(b.slice(0, last))
                b = b.slice(last)
            yield pa.Table.from_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)
