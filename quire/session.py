"""What the library needs of a Spark session."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: list[SparkContext] = []


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per context; they may run where it is not installed."""
    context = spark.sparkContext
    if any(c is context for c in _shipped):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped[:] = [context]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's path below the one that driver and executors share; below one of our own only where none is set and all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/quire/{name}-{uuid.uuid4().hex[:12]}"
