"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Of this process, where a session on one machine names no shared folder.
OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and master is ``local`` (tests, one machine) is it a
    temporary folder, removed at exit; on a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[[^,]*(, *\d+)?\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share before the session starts")
    if not OWN_DIR:
        OWN_DIR.append(tempfile.mkdtemp(prefix="stridewell-"))
        atexit.register(shutil.rmtree, OWN_DIR[0], ignore_errors=True)
    return OWN_DIR[0]


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"
