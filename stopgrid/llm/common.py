"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..session import ship

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    ship(spark)
    return tables.shared_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and the rows survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of phases that are over: it does so when the driver's garbage is collected, which on a large heap may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch a worker gives free memory back to the system: it stays for the next tasks, while the executor works without it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(taken: list[str], *names: str) -> list[str]:
    """Names like these that none of the columns has."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def hinted(df: DataFrame, hashed: Column, keys: DataFrame, n: int, name: str) -> DataFrame:
    """df with a boolean ``name``: whether a row's hash may be among the n hashes of keys (one long column). It is true for all that are, and for few others.

    keys become a bitmap of about 16 bits for each, 16 MB at most (beyond, it is only true for more rows), which is broadcast; so a join
    after it only moves rows that it needs.
    """
    bits = min(max(1 << (16 * n).bit_length(), 1 << 15), 1 << 27)
    bucket, bitmap = spare([*df.columns, name], "_bucket", "_bits")
    held = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(bits)).alias("v")).groupBy(F.bitmap_bucket_number("v").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias(bitmap))
    v = F.pmod(hashed, F.lit(bits))
    at = F.bitmap_bit_position(v)
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1) == 1
    return df.join(F.broadcast(held), F.bitmap_bucket_number(v) == F.col(bucket), "left").withColumn(name, F.coalesce(is_set, F.lit(False))).drop(bucket, bitmap)


def maybe_in(df: DataFrame, hashed: Column, keys: DataFrame, n: int) -> DataFrame:
    """The rows of df that are hinted."""
    (hint,) = spare(df.columns, "_hint")
    return hinted(df, hashed, keys, n, hint).where(F.col(hint)).drop(hint)


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and the whole text, null as empty; nothing else is read."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def tasks_of(spark: SparkSession) -> int:
    """How many partitions a shuffle gets in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
