"""Texts for operations: derived ones, and the check that given ones say only what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

SEPARATOR = "\x1f"
# Verbs of methods.
VERBS = {"get": "Get", "post": "Create", "put": "Update", "patch": "Update", "delete": "Delete", "head": "Check", "options": "Get options for"}
# Names of functions that say nothing about what they do.
GENERIC = ["get", "post", "put", "delete", "patch", "handle", "index", "list", "apply", "call", "execute"]
# Leading segments that are no resource; what claims that users must sign in; what looks like a path.
BASE = "(?i)^(?:api|v[0-9]+|internal|actuator)$"
CLAIM = r"(?i)\b(requires? (?:an? )?(?:api key|bearer|oauth|authentication|authorization)|must be authenticated)\b"
PATHLIKE = r"(?<![\w.])(/[A-Za-z0-9_{}\-./]{2,})"


def words(name: Column) -> Column:
    """The lower-case words of a camel-, snake- or kebab-case name."""
    # fixed values: where a name's words begin
    apart = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[_\-]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " "), r"(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(apart), r"\s+"), lambda x: x != "")


def _sentence(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def summary(method: Column, path: Column, function: Column) -> Column:
    """The words of a function's name as a sentence, unless it says nothing; else a verb and the last plain segment."""
    own = words(F.element_at(F.split(F.coalesce(function, F.lit("")), "\\."), -1))
    told = F.coalesce(~F.get(own, 0).isin(GENERIC), F.lit(False))
    plain = F.filter(paths.segments(path), lambda x: ~x.startswith("{"))
    last = F.try_element_at(plain, F.lit(-1))
    resource = F.when(last.isNotNull(), F.array_join(words(last), " ")).otherwise("resource")
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    listed = (F.lower(method) == "get") & ~F.regexp_replace(path, "/+$", "").endswith("}") & last.isNotNull()
    verb = F.when(listed, "List").otherwise(F.coalesce(F.try_element_at(verbs, F.lower(method)), F.upper(method)))
    return F.when(told, _sentence(F.array_join(own, " "))).otherwise(F.trim(F.concat_ws(" ", verb, resource)))


def overviews(operations: DataFrame) -> DataFrame:
    """(repo_id, service, overview): a sentence on the service and its distinct resources, sorted."""
    plain = F.filter(paths.segments(F.col("path")), lambda x: ~x.startswith("{"))
    # the first segment that is no base; segments before it are bases all
    first = F.get(F.filter(plain, lambda x: ~x.rlike(BASE)), 0)
    rows = operations.where("NOT duplicate").select("repo_id", "service", F.translate(first, "-_", "  ").alias("resource"))
    each = rows.groupBy("repo_id", "service").agg(F.array_join(F.array_sort(F.collect_set("resource")), ", ").alias("r"))
    name = F.trim(F.translate("service", "-_", "  "))
    text = F.concat(F.lit("API for the "), name, F.lit("."), F.when(F.col("r") != "", F.concat(F.lit(" Provides operations over: "), "r", F.lit("."))).otherwise(""))
    return each.select("repo_id", "service", F.when(name != "", text).alias("overview"))


def vocabulary(operations: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, word): words that a text about an operation may use as tags."""
    parts = F.concat(F.filter(paths.segments(F.col("path")), lambda x: ~x.startswith("{")), F.col("parameters.name"), F.col("statuses"), F.col("tags"))
    return operations.where("NOT duplicate").select("repo_id", "service", "path", "method", F.explode(F.array_distinct(F.transform(parts, F.lower))).alias("word"))


def grounded(texts: DataFrame, operations: DataFrame, secured: DataFrame) -> DataFrame:
    """texts(repo_id, service, path, method, summary, description, tags, responses map, parameters map) with `reason`, null where a text states only what the operation does.

    secured(repo_id, service, path, method) lists operations with a security scheme; texts about no operation are left out.
    """
    key = ["repo_id", "service", "path", "method"]
    own = operations.where("NOT duplicate").select(*key, F.col("parameters.name").alias("_names"), F.col("statuses").alias("_statuses"))
    terms = vocabulary(operations).groupBy(*key).agg(F.collect_set("word").alias("_words"))
    rows = texts.join(own, key).join(terms, key, "left").join(secured.select(*key).distinct().withColumn("_secured", F.lit(True)), key, "left")
    blob = F.concat_ws(" ", "summary", "description", F.array_join(F.map_values("responses"), " "), F.array_join(F.map_values("parameters"), " "))
    none = F.array().cast("array<string>")
    numbers = F.array_except(F.regexp_extract_all(blob, F.lit(r"\b([1-5]\d{2})\b"), F.lit(1)), F.col("_statuses"))
    pathlike = F.filter(F.regexp_extract_all(blob, F.lit(PATHLIKE), F.lit(1)), lambda x: ~F.contains(F.col("path"), F.rtrim(x, F.lit("./"))))
    known = lambda t: F.array_contains("_words", t) | F.array_contains("_words", F.rtrim(t, F.lit("s"))) | F.array_contains("_words", F.concat(t, F.lit("s")))
    claims = blob.rlike(CLAIM)
    reason = (
        F.when(F.size(F.array_except(F.coalesce(F.map_keys("responses"), none), "_statuses")) > 0, "status not declared")
        .when(F.size(F.array_except(F.coalesce(F.map_keys("parameters"), none), "_names")) > 0, "parameter not declared")
        .when(F.size(numbers) > 0, "number of a status that is not declared")
        .when(F.size(pathlike) > 0, "path of another operation")
        .when(claims & F.col("_secured").isNull(), "authentication without security")
        .when(F.exists(F.coalesce("tags", none), lambda t: ~F.coalesce(known(F.lower(t)), F.lit(False))), "tag outside the vocabulary")
    )
    return rows.withColumn("reason", reason).drop("_names", "_statuses", "_words", "_secured")


def cache_key(provider: Column, model: Column, version: Column, payload: Column) -> Column:
    """The key of a stored answer."""
    return F.sha2(F.concat_ws(SEPARATOR, provider, model, version, payload), 256)


def looked_up(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their stored answer, requests without one), by cache_key."""
    return requests.join(cache.select("cache_key", "answer"), "cache_key"), requests.join(cache, "cache_key", "left_anti")
