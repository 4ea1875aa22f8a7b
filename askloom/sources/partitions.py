"""A store in partition folders from which rows are deleted: only the partitions concerned are rewritten.

Deletion has three steps. What stays of the partitions concerned is written beside the
store, with the list of these partitions; this counts once Spark's ``_SUCCESS`` is there.
Then they are replaced (or dropped, where nothing stays) and what was written beside is
removed. A run that dies in the first step has changed nothing; one that dies later is
completed by the next call from what lies beside the store, with the same result however
often it is repeated. Other partitions' files are neither read nor touched.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.util import broadcast_if, settle


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def partition_folder(spark: SparkSession, column: str, value) -> str:
    """The folder name of a partition value, escaped as Spark's writer does."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, None if value is None else str(value))


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows into partition folders; only the partitions among them are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store's rows; a deletion that was interrupted is completed first."""
    finish(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def finish(spark: SparkSession, path: str, schema) -> None:
    """Complete an interrupted deletion, or forget one that had not come to count."""
    beside = f"{path}-pending"
    if not exists(spark, beside):
        return
    if exists(spark, f"{beside}/rows/_SUCCESS"):
        _apply(spark, path, schema)
    remove(spark, beside)


def _same(by: list[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])


def _apply(spark: SparkSession, path: str, schema) -> None:
    beside = f"{path}-pending"
    touched = spark.read.parquet(f"{beside}/touched")
    by = touched.columns
    stays = spark.read.schema(schema).parquet(f"{beside}/rows")
    if not stays.isEmpty():
        write_partitions(stays, path, by)
    left = stays.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    for r in touched.join(left, _same(by), "left_anti").toLocalIterator():  # names of partitions, no rows
        remove(spark, "/".join([path, *(partition_folder(spark, c, r[c]) for c in by)]))


def delete_where(spark: SparkSession, path: str, by: list[str], concerned: Column | DataFrame, keep: Column | DataFrame, schema) -> None:
    """Of the partitions ``concerned`` keep the rows that fulfil ``keep``.

    ``by`` names the store's partition columns. ``concerned`` is a condition on them, or a
    table of values of the first one. ``keep`` is a condition, or a table of the keys (its
    column) whose rows go. Partitions of which every row stays are left alone.
    """
    settle(spark)
    finish(spark, path, schema)
    rows = spark.read.schema(schema).parquet(path)
    if isinstance(concerned, Column):
        rows = rows.filter(concerned)  # partition filter: other folders are not read
    else:
        rows = rows.join(broadcast_if(concerned.select(by[0]).distinct(), concerned), by[0], "left_semi")
    beside = f"{path}-pending"
    if isinstance(keep, Column):
        goes = ~F.coalesce(keep, F.lit(False))
        lost, stays = rows.filter(goes), rows.filter(~goes)
    else:
        lost, stays = (rows.join(broadcast_if(keep), keep.columns, how) for how in ("left_semi", "left_anti"))
    lost.select(*by).distinct().write.parquet(f"{beside}/touched")
    touched = spark.read.parquet(f"{beside}/touched").select(*[F.col(c).alias(f"_{c}") for c in by])
    stays.join(broadcast_if(touched), _same(by), "left_semi").write.parquet(f"{beside}/rows")
    finish(spark, path, schema)
