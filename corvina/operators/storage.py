"""Intermediate tables in the cluster's shared folder, which cut plans that would grow with each level of joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def cut(rows: DataFrame) -> DataFrame:
    """rows written below spark.checkpoint.dir and read back; a temporary folder serves only where that is unset in local mode, as in tests."""
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="corvina-")
    path = f"{root.rstrip('/')}/step-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
