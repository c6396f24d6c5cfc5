"""From facts of Java controllers and the modules of their builds to operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.java_types import STATUSES
from . import java_contracts
from .services import _PARAMETER, completed

_ROUTE = f"owner string, framework string, prefix string, method string, route string, function string, status string, parameters array<{_PARAMETER}>"


def modules(manifests: DataFrame) -> DataFrame:
    """(repo_id, root, module): the directory of each build file and its name."""
    rows = manifests.where("kind IN ('pom', 'gradle')").withColumn("root", F.regexp_replace("path", "/?[^/]*$", ""))
    return rows.groupBy("repo_id", "root").agg(F.coalesce(F.min(F.nullif("name", F.lit(""))), F.max(F.element_at(F.split("root", "/"), -1))).alias("module"))


def operations(facts: DataFrame, manifests: DataFrame, files: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """The same columns as services.operations(); a service is the deepest module above a controller, or the repository.

    files give the path below which a module's applications answer, types that of a JAX-RS application.
    """
    rows = facts.where("kind = 'route'").withColumn("v", F.from_json("value", _ROUTE)).select("repo_id", F.col("path").alias("file"), "line", "v.*")
    # the directories above a file, so that the deepest module is found by an equi join
    parts = F.split("file", "/")
    above = rows.select("repo_id", "file").distinct().select("repo_id", "file", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("root"))
    own = above.join(modules(manifests), ["repo_id", "root"]).groupBy("repo_id", "file").agg(F.max_by("module", F.length("root")).alias("service"))
    rows = rows.join(own, ["repo_id", "file"], "left").withColumn("service", F.coalesce("service", "repo_id"))
    rows = rows.withColumn("at", F.lit(""))
    if files is not None:
        stated = java_contracts.context_paths(files, modules(manifests))
        keys = F.create_map(*[F.lit(x) for pair in java_contracts.CONTEXT_KEYS.items() for x in pair])
        root = java_contracts.module_of(rows, modules(manifests))
        rows = rows.drop("at").withColumn("key", F.try_element_at(keys, F.col("framework"))).join(root, ["repo_id", "file"]).join(stated.withColumnRenamed("prefix", "at"), ["repo_id", "root", "key"], "left").drop("key", "root")
    if types is not None:
        applied = java_contracts.application_paths(java_contracts.index(types))
        rows = rows.join(applied, "repo_id", "left").withColumn("at", F.when(F.col("framework") == "jaxrs", F.col("application")).otherwise(F.col("at"))).drop("application")
    rows = rows.withColumn("path", F.regexp_replace(paths.join_path(F.coalesce("at", F.lit("")), F.col("prefix"), F.col("route")), r"\{(\w+)\s*:[^/]*\}", "{$1}"))
    order = ["file", "line", "function"]
    rows = rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("repo_id", "service", "path", "method").orderBy(*order)) > 1)
    rows = rows.withColumn("base", paths.operation_base(F.col("method"), F.col("path")))
    n = F.row_number().over(Window.partitionBy("repo_id", "service", "base").orderBy("duplicate", "path", "method", *order))
    codes = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    return rows.select("repo_id", "service", "framework", "path", "method", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string"))).alias("operation_id"), "function", "file", "line", F.lit(None).cast("string").alias("summary"), F.array(java_contracts.tag(F.col("owner"))).alias("tags"), completed(F.col("parameters")).alias("parameters"), F.array(F.coalesce(F.try_element_at(codes, F.col("status")).cast("string"), F.lit("200"))).alias("statuses"), "duplicate")
