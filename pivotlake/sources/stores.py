"""Small steps on folders of a table, through the file system Spark itself uses.

These run on the driver and handle whole folders, never rows or single files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds; nothing happens if there is none."""
    system, place = _at(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder; the folder above the target is made if need be."""
    system, place = _at(spark, path)
    _, to = _at(spark, target)
    system.mkdirs(to.getParent())
    if not system.rename(place, to):
        raise OSError(f"could not move {path} to {target}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders directly below ``path``: of a table its partitions."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())
