"""Tables written to the folder that all executors share, and passes over Arrow batches of bounded bytes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a filter.
FILTER = 1 << 18
#: Of a Python worker: bytes that malloc takes from its own heap and not from the system, and free ones at
#: the heap's top that it keeps. By default it gives back the arrays of each pass and faults them in again.
MALLOC_OWN, MALLOC_KEPT = 1 << 22, 1 << 26
#: Bytes of an Arrow batch that a Python worker gets at once; a row larger than that comes alone.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests, a temporary one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as a table, in folders by some columns, and read back, which cuts its lineage; the
    shuffle files of the write are removed when it is done."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path := fresh(spark, name))
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame, folder: str = "") -> None:
    """Deletes the files of a table that save() has returned and nothing reads any more, or one folder of them."""
    spark = df.sparkSession
    for f in {re.sub(r"(/tessel-[^/]*).*", r"\1", x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{f}/{folder}" if folder else f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_heap() -> None:
    """Has malloc keep up to MALLOC_KEPT for the arrays of the next pass, until give_back()."""
    if (option := getattr(ctypes.CDLL(None), "mallopt", None)) is not None:
        option(-3, MALLOC_OWN)  # M_MMAP_THRESHOLD
        option(-1, MALLOC_KEPT)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Gives free memory back to the system, as the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def collect_heaps(spark: SparkSession) -> None:
    """Has the executors collect their heaps, which gives free memory back to the system: a JVM keeps
    what the largest stage took, and Python workers need that memory in the next one. The tasks are
    as many as there are cores, so that each executor gets one if all of them are idle."""
    n = spark.sparkContext.defaultParallelism
    # Spark has no call for this; the expression runs where the rows are
    gc = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(gc.alias("done")).write.format("noop").mode("overwrite").save()


def by_group(run: Callable) -> Callable:
    """For applyInArrow: run, and memory is given back after each group."""

    def one(table: pa.Table) -> pa.Table:
        keep_heap()
        out = run(table)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        keep_heap()
        out = run(left, right)
        give_back()
        return out

    return one if run.__code__.co_argcount == 1 else two


def batched(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches of BATCH_BYTES at most, so that a worker's memory doesn't follow the
    length of the rows. Lowers spark.sql.execution.arrow.maxBytesPerBatch of the session if it is higher."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        yield from run(batches)
        give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(freed, schema)


def free(columns: list[str], name: str) -> str:
    """name, with underscores after it until none of columns is called so in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of the column that df[name] is."""
    return [c.lower() for c in df.columns].index(name.lower())


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """FILTER words of 64 bits that tell which longs may be in the only column of hashes: bits are set
    by their 18 highest and 6 lowest bits. FILTER rows at most come to the driver."""
    by_word = hashes.toDF("h").groupBy(F.shiftrightunsigned("h", 46).alias("k"))
    got = by_word.agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("w")).toArrow()
    bits = np.zeros(FILTER, np.uint64)
    bits[got["k"].to_numpy()] = got["w"].to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be among those of the filter; never wrong about one that is."""
    return (bits[(h >> np.uint64(46)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0
