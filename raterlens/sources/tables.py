"""Readers for the Parquet tables the jobs start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Read one table; selecting ``columns`` here lets the scan prune the rest
    (``ReadSchema`` in the plan carries only these)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return df


def table_versions(spark: SparkSession, sf_dir: str, names) -> tuple:
    """Length and modification time of each table's files, from the store's
    own listing (any store that Spark reads)."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            out.append((name, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime())
                                           for f in fs.listStatus(path)))))
    return tuple(out)
