"""Path checks through Hadoop's file system, so they work on any storage."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def find_files(spark: SparkSession, root: str, name: str) -> list[str]:
    """Sorted paths of files called ``name`` anywhere under ``root``."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = []
    listing = fs.listFiles(p, True)
    while listing.hasNext():
        path = listing.next().getPath()
        if path.getName() == name:
            found.append(path.toString())
    return sorted(found)


def join(*parts) -> str:
    head, *rest = [str(p) for p in parts]
    return "/".join([head.rstrip("/")] + [p.strip("/") for p in rest])
