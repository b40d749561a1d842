"""Vectors as little-endian float32 bytes, digests of files, coefficients from exponents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_bytes(vec: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vec)


def from_bytes(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpack(blob)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256 and bytes of files; contents are read where they lie."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


def dense(coefs: Column, rows: int, cols: int) -> Column:
    """rows x cols coefficients from an array of structs (i, j, value); missing ones are 0."""
    keyed = F.map_from_entries(F.transform(coefs, lambda c: F.struct((c["i"] * cols + c["j"]).cast("int").alias("k"), c["value"].cast("double").alias("v"))))
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.coalesce(F.try_element_at(keyed, (i * cols + j).cast("int")), F.lit(0.0))))
