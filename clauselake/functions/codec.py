"""Vectors as bytes for a cold copy: float32 for dense ones, JSON for sparse ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.arrow_udf(BinaryType())
def _packed(vectors: pa.Array) -> pa.Array:
    """The values of each list as little-endian float32, one behind the other."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    ends = np.append(0, np.cumsum(vectors.value_lengths().fill_null(0).to_numpy())) * 4
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


@F.arrow_udf(ArrayType(FloatType()))
def _unpacked(data: pa.Array) -> pa.Array:
    joined = b"".join(x.as_py() for x in data)
    ends = np.append(0, np.cumsum([len(x.as_py()) // 4 for x in data])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(joined, dtype="<f4")))


def dense_bytes(vector: Column) -> Column:
    """A vector as little-endian float32 bytes, NaN and infinities as they are; null if it or one of its values is null."""
    floats = F.transform(vector, lambda x: x.cast("float"))
    whole = vector.isNotNull() & F.forall(floats, lambda x: x.isNotNull())
    return F.when(whole, _packed(F.when(whole, floats).otherwise(F.array().cast("array<float>"))))


def dense_vector(data: Column) -> Column:
    """The vector of such bytes; null if their number is no multiple of four."""
    whole = data.isNotNull() & (F.octet_length(data) % 4 == 0)
    return F.when(whole, _unpacked(F.when(whole, data).otherwise(F.lit(b""))))


def sparse_bytes(vector: Column) -> Column:
    """A map of weights by token as UTF-8 JSON with the tokens as text."""
    return F.encode(F.to_json(F.transform_keys(vector, lambda k, _: k.cast("string"))), "UTF-8")


def sparse_vector(data: Column) -> Column:
    """The map of such bytes, tokens as text."""
    return F.from_json(F.decode(data, "UTF-8"), "map<string,double>")


def numbered_tokens(vector: Column) -> Column:
    """A map with its tokens as numbers; those that are none go."""
    numbers = F.map_filter(vector, lambda k, _: k.try_cast("bigint").isNotNull())
    return F.transform_keys(numbers, lambda k, _: k.cast("bigint"))
