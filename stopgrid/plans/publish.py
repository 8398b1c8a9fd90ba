"""Publishing: versioned tables behind a pointer, redirects of vanished keys, and usage counts that follow them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rel import first_per, upsert_add

#: Tables whose readers ask for one mode are laid out by it.
BY_MODE = ("station_names", "stations", "station_objects")


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(tables: dict[str, DataFrame], root: str, keep: int = 2) -> str:
    """Writes a new version beside the live one, then makes all its tables live at once: the file LIVE, which names the version, is
    written beside and renamed over the old one. Readers of the old version go on; versions before the last ``keep`` are deleted."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        # by mode first, as the writer sorts by the partition's column unless rows come so
        writer = df.sortWithinPartitions("mode", "folded").write if {"mode", "folded"} <= set(df.columns) else df.write
        (writer.partitionBy("mode") if name in BY_MODE else writer).parquet(f"{root}/{version}/{name}")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI.create(root), spark._jsc.hadoopConfiguration())
    fs, made = _fs(spark, f"{root}/LIVE-{version}")
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(made, jvm.org.apache.hadoop.fs.Path(f"{root}/LIVE"), options)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root)) if s.isDirectory())
    for old in versions[: -keep or None]:
        if old != version:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return version


def live_version(spark: SparkSession, root: str) -> str | None:
    fs, live = _fs(spark, f"{root}/LIVE")
    return spark.read.text(f"{root}/LIVE").first()["value"] if fs.exists(live) else None


def live_tables(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """A reader of the version that is live now: all tables it gives are of that one, whatever is published meanwhile."""
    version = live_version(spark, root)
    return lambda name: spark.read.parquet(f"{root}/{version}/{name}")


def read_live(spark: SparkSession, root: str, name: str) -> DataFrame:
    return live_tables(spark, root)(name)


def prewarm(df: DataFrame) -> DataFrame:
    """df in memory (and on disk, where it doesn't fit)."""
    out = df.persist()
    out.count()
    return out


def key_redirects(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """mode, old_key, new_key: where keys lead that are in the old stations or redirects (old: stations, objects, redirects), but no longer
    in the new stations (new: stations, objects): to the station that holds most of the old station's objects, if any does."""
    known = old["stations"].where("station_key is not null").select("mode", F.col("station_key").alias("old_key"), F.col("station_key").alias("live_key"))
    known = known.unionByName(old["redirects"].select("mode", "old_key", F.col("new_key").alias("live_key")))
    have = new["stations"].where("station_key is not null").select("mode", "station_key")
    gone = known.join(have.withColumnRenamed("station_key", "old_key"), ["mode", "old_key"], "left_anti")
    was = gone.select("mode", "live_key").distinct().join(old["stations"].select("mode", "key", F.col("station_key").alias("live_key")), ["mode", "live_key"])
    was = was.join(old["objects"].select("mode", "key", "osm_type", "osm_id"), ["mode", "key"]).drop("key")
    now = new["objects"].select("mode", "key", "osm_type", "osm_id").join(new["stations"].select("mode", "key", F.col("station_key").alias("new_key")), ["mode", "key"]).drop("key")
    counts = was.join(now, ["mode", "osm_type", "osm_id"]).groupBy("mode", "live_key", "new_key").agg(F.count(F.lit(1)).alias("n"))
    moved = first_per(counts, ["mode", "live_key"], [F.col("n").desc(), F.col("new_key")]).drop("n")
    still = have.select("mode", F.col("station_key").alias("live_key"), F.col("station_key").alias("_still"))
    out = gone.join(still, ["mode", "live_key"], "left").join(moved, ["mode", "live_key"], "left").withColumn("new_key", F.coalesce("_still", "new_key")).where("new_key is not null")
    return first_per(out, ["mode", "old_key"], [(F.col("old_key") == F.col("live_key")).desc(), F.col("new_key")]).select("mode", "old_key", "new_key")


def follow_redirects(usage: DataFrame, redirects: DataFrame) -> DataFrame:
    """usage (mode, station_key, users) with redirected keys' counts added to where they lead."""
    r = redirects.select("mode", F.col("old_key").alias("station_key"), "new_key")
    moved = usage.join(r, ["mode", "station_key"]).select("mode", F.col("new_key").alias("station_key"), "users")
    return upsert_add(usage.join(r, ["mode", "station_key"], "left_anti"), moved, ["mode", "station_key"], "users")
