"""Vectors as bytes and back."""

import math
import struct

from pyspark.sql import functions as F

from clauselake.functions import codec


def test_dense_bytes_and_back(spark):
    vectors = [[1.5, -2.25], [], [float("nan"), float("inf"), -0.0], None, [1.0, None], [1e39], [0.1]]
    frame = spark.createDataFrame(list(enumerate(vectors)), "i int, v array<double>").repartition(2)
    rows = frame.select("i", codec.dense_bytes(F.col("v")).alias("b")).withColumn("w", codec.dense_vector(F.col("b"))).orderBy("i").collect()
    assert [None if r.b is None else bytes(r.b) for r in rows] == [struct.pack("<2f", 1.5, -2.25), b"", struct.pack("<3f", math.nan, math.inf, -0.0), None, None, struct.pack("<f", math.inf), struct.pack("<f", 0.1)]
    assert [r.w for r in rows][:2] == [[1.5, -2.25], []] and math.isnan(rows[2].w[0]) and rows[2].w[1:] == [math.inf, -0.0] and rows[3].w is None
    odd = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"\0" * 8),), (None,)], "b binary")
    assert [r.w for r in odd.select(codec.dense_vector(F.col("b")).alias("w")).collect()] == [None, [0.0, 0.0], None]
    assert frame.limit(0).select(codec.dense_bytes(F.col("v"))).count() == 0


def test_sparse_bytes_and_back(spark):
    frame = spark.createDataFrame([({3: 1.5, 70: 0.25},), ({},), (None,)], "m map<bigint,double>")
    rows = frame.select(codec.sparse_bytes(F.col("m")).alias("b")).withColumn("m", codec.numbered_tokens(codec.sparse_vector(F.col("b")))).collect()
    assert [r.m for r in rows] == [{3: 1.5, 70: 0.25}, {}, None] and bytes(rows[1].b) == b"{}"
    kept = spark.createDataFrame([(bytearray(b'{"7": 0.5, "word": 2.0}'),)], "b binary")
    assert kept.select(codec.numbered_tokens(codec.sparse_vector(F.col("b"))).alias("m")).first().m == {7: 0.5}
