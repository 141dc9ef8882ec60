"""Image bytes and object listings; local paths and object stores differ only in the path."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from .shards import file_system

_FOLDERS = 256  # of files written one by one


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


def write_texts(rows: DataFrame, path: str) -> None:
    """One file per ``name`` with its ``value`` lines, dealt over folders below ``path``.

    Tasks write the files under their own names, so nothing is renamed; a repeated
    task writes the same files again.
    """
    folder = F.format_string("%03d", F.pmod(F.xxhash64("name"), F.lit(_FOLDERS)))
    placed = rows.select(folder.alias("folder"), "name", "value")
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism

    def write(part: Iterator[Row]) -> None:
        system, root = file_system(path)
        for (folder, name), lines in groupby(part, key=lambda row: (row.folder, row.name)):
            with suppress(FileExistsError):
                system.create_dir(f"{root}/{folder}", recursive=True)
            with system.open_output_stream(f"{root}/{folder}/{name}") as out:
                for line in lines:
                    out.write(f"{line.value}\n".encode())

    placed.repartition(parts, "folder", "name").sortWithinPartitions("folder", "name").foreachPartition(write)


def read_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content, name``."""
    return _files(spark, path, recursive).withColumn("name", basename(F.col("path")))


def _relative(spark: SparkSession, path: Column, base: str) -> Column:
    """The path below ``base``, cut from the front, so a repeated folder name does no harm."""
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return F.substring(path, len(whole.rstrip("/")) + 2, 1 << 30)


def list_folder(spark: SparkSession, base: str) -> DataFrame:
    """S6, local form: files and folders one level below ``base``, relative and sorted.

    Only paths are read; file contents are pruned from the scan. Names that begin with
    ``_`` or ``.`` and empty folders are not listed, as the file source hides them.
    """
    entry = F.split_part(_relative(spark, F.col("path"), base), F.lit("/"), F.lit(1))
    return _files(spark, base, True).select(entry.alias("name")).distinct().orderBy("name")


def list_prefix(spark: SparkSession, base: str, prefix: str = "") -> DataFrame:
    """S6, object-store form: every key below ``base`` that starts with the string ``prefix``."""
    keys = _files(spark, base, True).select(_relative(spark, F.col("path"), base).alias("key"), "length")
    return keys.filter(F.col("key").startswith(prefix)).orderBy("key")


def existing(records: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """Records whose ``name`` is in the listing; one join, no call per row."""
    return records.join(listing.select(name).distinct(), name, "left_semi")


def missing(records: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    return records.join(listing.select(name).distinct(), name, "left_anti")
