"""A folder that driver and executors share, for tables and files that a query leaves on its way."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a local session without it gets one that goes at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="snapstore-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        root = "file://" + _own["dir"]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_path(folder: str) -> str:
    """The folder as a path for files; record files need a folder that all machines mount."""
    if re.match(r"[a-z][a-z0-9+.-]*:", folder) and not folder.startswith("file:"):
        raise ValueError(f"record files need a mounted folder, not {folder}")
    return re.sub(r"^file:/*", "/", folder)
