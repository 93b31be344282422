"""Files as tasks see them, on a local or mounted folder or a store that Arrow opens."""

from __future__ import annotations

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI, by the file system that Spark takes for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> list[tuple[str, int]]:
    """Path and size of the files of a folder, by Spark's own file systems; not those of
    its folders, but hidden ones too.  No such folder is an empty one."""
    import fnmatch

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not hadoop.exists(path):
        return []
    found = [(f.getPath(), f.getLen()) for f in hadoop.listStatus(path) if f.isFile()]
    return sorted((p.toString(), n) for p, n in found if fnmatch.fnmatchcase(p.getName(), pattern))


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; it need not exist."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
