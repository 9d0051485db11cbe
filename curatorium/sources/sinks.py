"""Snapshot, conditional and append sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.operators.sets import table_digest

PREFIX = "version="
#: Folders per run; one task writes a folder, one task lists it.
SHARDS = 256


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, jvm = _fs(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[len(PREFIX) :]) for n in names if n.startswith(PREFIX) and n[len(PREFIX) :].isdigit())


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the published version folder, the one with the highest number, or None."""
    versions = _versions(spark, root)
    return f"{PREFIX}{versions[-1]}" if versions else None


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no published snapshot under {root}")
    return spark.read.parquet(f"{root}/{version}")


def overwrite_snapshot(df: DataFrame, root: str) -> str:
    """Write a whole new version beside the others, then publish it by one rename to the next number.

    A crash before the rename leaves the old version published; there is no state in between.  One writer per root: with two,
    the slower one finds its number taken and fails.
    """
    spark = df.sparkSession
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    fs, jvm = _fs(spark, root)
    versions = _versions(spark, root)
    version = f"{PREFIX}{versions[-1] + 1 if versions else 0}"
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{version}")
    if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        raise RuntimeError(f"{root}/{version} could not be published")
    for old in versions[:-1]:  # the one before stays for its readers
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{PREFIX}{old}"), True)
    return version


def write_if_changed(df: DataFrame, root: str) -> bool:
    """Publish a new version only when the table digest differs; tells whether it wrote."""
    spark = df.sparkSession
    if current_version(spark, root) is not None:
        old = table_digest(read_snapshot(spark, root)).first()
        if old == table_digest(df).first():
            return False
    overwrite_snapshot(df, root)
    return True


def append_ledger(rows: DataFrame, path: str, seq: str = "seq") -> None:
    """Append rows whose sequence numbers follow the stored ones; anything else is refused.  One writer per ledger."""
    spark = rows.sparkSession
    fs, jvm = _fs(spark, path)
    last = -1
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path)):
        last = spark.read.parquet(path).agg(F.coalesce(F.max(seq), F.lit(-1))).first()[0]
    check = rows.agg(F.min(seq).alias("low"), F.count(seq).alias("n"), F.count_distinct(seq).alias("d")).first()
    if check["n"] and (check["low"] <= last or check["n"] != check["d"]):
        raise ValueError(f"sequence must grow past {last} without repeats")
    rows.write.mode("append").parquet(path)


def write_artifacts(rows: DataFrame, path: str, run: str, identity: str, text: str) -> None:
    """One file per run and identity, ``path/run/shard/identity.json``; lines of one identity share its file.

    A folder per identity costs more than its file: it is made, renamed at commit and listed one by one.  Here identities are
    dealt by hash over folders and each folder is written by one task, through the file system that the path names.  A
    repeated task writes the same names again.  Identities must be fit to be file names.
    """

    store, jvm = _fs(rows.sparkSession, path)
    path = store.makeQualified(jvm.org.apache.hadoop.fs.Path(path)).toUri().toString()

    def write(part) -> None:
        from itertools import groupby

        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(path)
        made = set()
        for (shard, name, identified), lines in groupby(part, lambda r: (r[0], r[1], r[2])):
            if "/" in identified or identified.startswith((".", "_")):
                raise ValueError(f"not a file name: {identified!r}")
            folder = f"{root}/{name}/{shard:04d}"
            if folder not in made:
                target.create_dir(folder)
                made.add(folder)
            with target.open_output_stream(f"{folder}/{identified}.json") as out:
                out.write("".join(f"{r[3]}\n" for r in lines).encode())

    shard = F.pmod(F.xxhash64(identity), F.lit(SHARDS)).cast("int").alias("shard")
    lines = rows.select(shard, run, identity, F.coalesce(text, F.lit("")).alias("line"))
    dealt = lines.repartition(SHARDS, "shard").sortWithinPartitions("shard", run, identity)
    dealt.foreachPartition(write)
