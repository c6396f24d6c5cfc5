"""Readiness of services: weighted scores, production gates, and the report over all services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text

# Shares of the score, and least completeness of a service that may ship.
WEIGHTS = {"gates": 0.30, "validation": 0.20, "confidence": 0.20, "responses": 0.15, "requests": 0.10, "parameters": 0.05}
LEAST = {"response_completeness": 0.75, "request_completeness": 0.75, "parameter_completeness": 0.90}
MOST_UNRESOLVED = 0


def share(high: Column, medium: Column, low: Column) -> Column:
    """How sure the facts of a service are: medium ones count half."""
    return (high + 0.5 * medium) / F.greatest(high + medium + low, F.lit(1))


def score(rows: DataFrame) -> Column:
    """The unrounded score, from 0 to 1, of rows(gates_passed, gates, errors, high, medium, low, *_completeness, failures)."""
    c = F.col
    parts = {
        "gates": F.when(c("gates") > 0, c("gates_passed") / c("gates")).otherwise(1.0),
        "validation": F.when(c("errors") == 0, 1.0).otherwise(0.0),
        "confidence": share(c("high"), c("medium"), c("low")),
        "responses": c("response_completeness"),
        "requests": c("request_completeness"),
        "parameters": c("parameter_completeness"),
    }
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * parts[name]
    # each failed enrichment costs two hundredths, all together fifteen at most
    return F.when(c("failures") > 0, total * F.greatest(F.lit(0.85), 1 - 0.02 * c("failures"))).otherwise(total)


def issues(least: dict[str, float] | None = None, most_unresolved: int = MOST_UNRESOLVED) -> Column:
    """What keeps a service from production, as an array of texts."""
    found = [F.when(F.col("unresolved") > most_unresolved, F.concat(F.col("unresolved").cast("string"), F.lit(" unresolved")))]
    found += [F.when(F.col(name) < bound, F.lit(f"{name.replace('_', ' ')} below {bound}")) for name, bound in (least or LEAST).items()]
    found += [F.when(F.col("errors") > 0, F.lit("validation errors")), F.when(F.col("gates_passed") < F.col("gates"), F.lit("failed gates"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def coverage(operations: DataFrame, gates: DataFrame, internal: list[str] | None = None, errors: DataFrame | None = None, failures: DataFrame | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """rows for scored(): one a service, over its operations outside internal paths. A fact is high if the source states it, medium if a default stands in, low if nothing is known.

    operations(repo_id, service, path, method, parameters, statuses, duplicate, request, response), gates(repo_id, service, gate, passed), errors(repo_id, service, message) of documents, failures(repo_id, service) of texts that were asked for, unresolved(repo_id, service) contracts, a row each; none where they are not given.
    """
    key = ["repo_id", "service"]
    rows = operations.where(~F.col("duplicate") & ~paths.is_internal(F.col("path"), internal or []))
    inside = F.exists("parameters", lambda p: p["location"].isin("body", "form", "file"))
    empty = F.array_contains("statuses", "204")
    typed = F.size(F.filter("parameters", lambda p: p["type"].isNotNull() & (p["type"] != "")))
    known = F.col("response").isNotNull() & (F.col("response") != "{}")
    request = F.col("request").isNotNull() & (F.col("request") != "{}")
    each = rows.groupBy(*key).agg(
        F.count("*").alias("operations"), F.countDistinct("path").alias("endpoints"),
        F.count_if(known | empty).alias("_answered"), F.count_if(inside).alias("_bodies"), F.count_if(inside & request).alias("_asked"),
        F.sum(F.size("parameters")).alias("_parameters"), F.sum(typed).alias("_typed"))
    ratio = text.safe_ratio
    each = each.withColumns({
        "response_completeness": ratio(F.col("_answered"), F.col("operations")), "request_completeness": ratio(F.col("_asked"), F.col("_bodies")), "parameter_completeness": ratio(F.col("_typed"), F.col("_parameters")),
        "high": F.col("_answered") + F.col("_asked") + F.col("_typed"), "medium": F.col("operations") - F.col("_answered"), "low": F.col("_bodies") - F.col("_asked") + F.col("_parameters") - F.col("_typed")})
    for name, found in (("errors", errors), ("failures", failures), ("unresolved", unresolved)):
        each = each.withColumn(name, F.lit(0).cast("long")) if found is None else each.join(found.groupBy(*key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])
    passed = gates.groupBy(*key).agg(F.count("*").alias("gates"), F.count_if("passed").alias("gates_passed"))
    return each.drop("_answered", "_bodies", "_asked", "_parameters", "_typed").join(passed, key, "left").fillna(0, ["gates", "gates_passed"])


def scored(rows: DataFrame, least: dict[str, float] | None = None, most_unresolved: int = MOST_UNRESOLVED) -> DataFrame:
    """rows with readiness (0 to 100, one decimal), issues and production_ready."""
    out = rows.withColumn("readiness", F.round(100 * score(rows), 1)).withColumn("issues", issues(least, most_unresolved))
    return out.withColumn("production_ready", F.size("issues") == 0)


def overall(scored: DataFrame) -> DataFrame:
    """One row: the mean readiness, and whether every service is ready."""
    return scored.agg(F.round(F.avg("readiness"), 1).alias("readiness"), F.bool_and("production_ready").alias("production_ready"), F.count("*").alias("services"), *([F.bool_and(F.col("gates_passed") == F.col("gates")).alias("strict_ok")] if "gates" in scored.columns else []))
