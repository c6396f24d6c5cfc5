"""Facts of repository snapshots that arrive over time, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python_facts import facts


def changed_files(snapshots: DataFrame, late: str = "1 day") -> DataFrame:
    """snapshots(repo_id, path, length, content, seen timestamp) without files that came before with equal bytes; what is remembered ends `late` after it was seen."""
    digest = snapshots.withColumn("digest", F.sha2("content", 256)).withWatermark("seen", late)
    return digest.dropDuplicatesWithinWatermark(["repo_id", "path", "digest"])


def changed_facts(snapshots: DataFrame, late: str = "1 day") -> DataFrame:
    """The facts of changed files, each time that they change."""
    return facts(changed_files(snapshots, late).select("repo_id", "path", "length", "content"))
