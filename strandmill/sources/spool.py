"""Folders for what a run writes and reads again."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder beneath ``spark.checkpoint.dir``, deleted when the process ends; a temporary one if a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if named is not None and urlsplit(named).scheme not in ("", "file"):
        raise RuntimeError("reads are written to mounted paths")
    base = urlsplit(named).path if named else tempfile.gettempdir()
    os.makedirs(path := os.path.join(base, f"strandmill-files-{uuid.uuid4().hex}"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
