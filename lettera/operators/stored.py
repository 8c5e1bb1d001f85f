"""Where operators keep tables that later queries read: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

_KEPT: dict[tuple[str, str, str], Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a temporary one in local mode and else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lettera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def once(spark: SparkSession, what: str, of: str, make: Callable[[str], Any]) -> Any:
    """What make(a new folder) gives, made once an application for each `of`, the path of what it is made from."""
    key = (spark.sparkContext.applicationId, what, of)
    if key not in _KEPT:
        _KEPT[key] = make(fresh(spark, what))
    return _KEPT[key]
