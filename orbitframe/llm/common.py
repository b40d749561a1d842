"""What the training-data operators share: reading, Arrow row maps, words, durable cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Rows of an Arrow batch handled at once in Python; bounds what one step expands in memory.
STEP_ROWS = 256
STEP_CHARS = 4_000_000
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that very long texts don't gather in one batch; a session with smaller ones keeps its own.

    The queries call it, not the operators.  It isn't set back: Arrow batches are made when the returned, lazy rows are read.
    """
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written in the folder that all executors share.

    The folder is the session's checkpoint folder, or the one that spark.checkpoint.dir names.  Where neither is set, a
    local session makes a folder of its own; on a cluster no folder of one machine would do, so that is an error.
    Unlike a checkpoint, which keeps the planner's guess of its size, a table has its true size: in loops the
    guesses of joins multiply round by round, until planning itself takes minutes.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the table of what durable() returned, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._durable)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def steps(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices that hold a bounded number of rows and, but for single rows, of characters."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.zeros(n, np.int64)
        col = batch.column(text)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        start = 0
        total = 0
        for i in range(n):
            if i > start and (i - start >= STEP_ROWS or total + sizes[i] > STEP_CHARS):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(sizes[i])
        yield batch.slice(start, n - start)


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str, text: int = 1) -> DataFrame:
    """fn gets the named columns in slices and returns lists by output column; the first column is passed on as it is.

    text is the place of the column by whose size rows are sliced.
    """
    fields = to_arrow_schema(T._parse_datatype_string(schema))
    first = fields.names[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            out = fn(part)
            out.setdefault(first, part.column(0))
            yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in fields], schema=fields)

    return df.select(*columns).mapInArrow(run, schema)


def texts(col: pa.Array) -> list[str]:
    """Null texts are empty."""
    return [x or "" for x in col.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def rolling(x: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of so many values, by doubling."""
    if len(x) < length:
        return np.empty(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    cur, clen, acc, alen, bits = x.astype(np.uint64), 1, None, 0, length
    while True:
        if bits & 1:
            if acc is None:
                acc, alen = cur, clen
            else:
                m = len(acc) - clen
                acc, alen = acc[:m] * power(clen) + cur[alen : alen + m], alen + clen
        bits >>= 1
        if not bits:
            return acc[: len(x) - length + 1]
        m = len(cur) - clen
        cur, clen = cur[:m] * power(clen) + cur[clen : clen + m], clen * 2


def loose(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with keys that the planner doesn't see as dealt out already.

    A join with an aggregate on its own keys would run in the aggregate's stage, where a hot key is one task's; with an
    exchange of its own, AQE can split it.
    """
    texts_of = {c for c, t in df.dtypes if t == "string"}
    same = lambda c: F.concat(F.col(c), F.lit("")) if c in texts_of else F.bitwise_not(F.bitwise_not(F.col(c)))
    return df.select(*[same(c).alias(c) if c in keys else F.col(c) for c in df.columns])


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder 0 by 5; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
