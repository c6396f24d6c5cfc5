"""From facts of Python sources to services, routes, operations and documents, with joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import relational
from ..operators.storage import cut

_ROUTER = "framework string, role string, name string, prefix string, title string, tags array<string>"
_INCLUDE = "owner_module string, owner string, target_module string, target string, prefix string, tags array<string>"
_PARAMETER = "struct<name:string,location:string,required:boolean,type:string,ref:string>"
_ROUTE = f"owner_module string, owner string, methods array<string>, route string, function string, status int, summary string, parameters array<{_PARAMETER}>, requested array<{_PARAMETER}>"


def _of(facts: DataFrame, kind: str, schema: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).withColumn("v", F.from_json("value", schema)).select("repo_id", "path", "module", "line", "v.*")


def _resolved(rows: DataFrame, routers: DataFrame, module: str, name: str, to: str) -> DataFrame:
    """rows with the router that (module, name) refers to, as column `to` (path:name).

    A module is named from any directory above its package; of several, the one that shares most leading directories with the file that refers to it, then the smallest path.
    """
    parts = F.split("r_module", "\\.")
    known = routers.select(F.col("repo_id").alias("r_repo"), F.col("path").alias("r_path"), F.col("module").alias("r_module"), F.col("name").alias("r_name"))
    known = known.withColumn("r_suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))))
    hit = rows.withColumn("_id", F.xxhash64("repo_id", "path", "line", module, name)).join(known, (F.col("repo_id") == F.col("r_repo")) & (F.col(module) == F.col("r_suffix")) & (F.col(name) == F.col("r_name")))
    shared = F.size(F.filter(F.zip_with(F.split("path", "/"), F.split("r_path", "/"), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    first = relational.keep_first(hit.withColumn("_shared", shared), [*[c for c in ("_id", "path", "line")], module, name], [F.desc("_shared"), "r_path"])
    return first.withColumn(to, F.concat_ws(":", "r_path", "r_name")).drop("_id", "_shared", "r_repo", "r_path", "r_module", "r_name", "r_suffix")


def mounts(facts: DataFrame) -> DataFrame:
    """(repo_id, service, framework, router, prefix, tags): each router below an app, once for each prefix that it is mounted at."""
    routers = _of(facts, "router", _ROUTER)
    key = F.concat_ws(":", "path", "name")
    includes = _of(facts, "include", _INCLUDE).withColumnRenamed("prefix", "i_prefix").withColumnRenamed("tags", "i_tags")
    includes = _resolved(_resolved(includes, routers, "owner_module", "owner", "owner_key"), routers, "target_module", "target", "target_key").select("repo_id", "owner_key", "target_key", "i_prefix", "i_tags")
    own = routers.select("repo_id", key.alias("target_key"), F.col("prefix").alias("own_prefix"), F.col("tags").alias("own_tags"))
    edges = cut(includes.join(own, ["repo_id", "target_key"]).withColumnRenamed("repo_id", "e_repo"))
    now = routers.where("role = 'app'").select("repo_id", key.alias("service"), "framework", key.alias("router"), F.lit("").alias("prefix"), "tags", F.array(key).alias("seen"))
    found = now = cut(now)
    while True:
        # a router is not mounted below itself
        step = now.join(edges, (F.col("repo_id") == F.col("e_repo")) & (F.col("router") == F.col("owner_key"))).where(~F.array_contains("seen", F.col("target_key")))
        # a prefix given at the inclusion replaces a blueprint's own one; routers add theirs
        prefix = F.when(F.col("framework") == "flask", F.concat("prefix", F.when(F.col("i_prefix") != "", F.col("i_prefix")).otherwise(F.col("own_prefix")))).otherwise(F.concat("prefix", "i_prefix", "own_prefix"))
        now = step.select("repo_id", "service", "framework", F.col("target_key").alias("router"), prefix.alias("prefix"), F.array_distinct(F.concat("tags", "i_tags", "own_tags")).alias("tags"), F.concat("seen", F.array("target_key")).alias("seen"))
        now = cut(now)
        if now.isEmpty():
            break
        found = found.unionByName(now)
    return found.drop("seen").distinct()


def completed(parameters: Column) -> Column:
    """parameters and those of `path` that they leave out."""
    missing = F.array_except(F.regexp_extract_all("path", F.lit("\\{(\\w+)\\}"), F.lit(1)), F.transform(F.filter(parameters, lambda p: p["location"] == "path"), lambda p: p["name"]))
    return F.concat(parameters, F.transform(missing, lambda m: F.struct(m.alias("name"), F.lit("path").alias("location"), F.lit(True).alias("required"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("ref"))))


def operations(facts: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, operation_id, function, file, line, tags, parameters, statuses, duplicate): every route of every app. Later routes of the same path and method are marked as duplicates."""
    routes = _resolved(_of(facts, "route", _ROUTE), _of(facts, "router", _ROUTER), "owner_module", "owner", "router")
    rows = routes.withColumnRenamed("path", "file").join(mounts(facts), ["repo_id", "router"])
    joined = paths.typed_template(F.regexp_replace(F.concat(F.lit("/"), "prefix", F.lit("/"), "route"), "/{2,}", "/"))
    rows = rows.withColumn("path", joined).withColumn("method", F.explode("methods"))
    order = ["file", "line", "function"]
    rows = rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("repo_id", "service", "path", "method").orderBy(*order)) > 1)
    rows = rows.withColumn("base", paths.operation_base(F.col("method"), F.col("path")))
    n = F.row_number().over(Window.partitionBy("repo_id", "service", "base").orderBy("duplicate", "path", "method", *order))
    rows = rows.withColumn("operation_id", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string"))))
    # a Flask handler's own arguments are those of the path; what it reads of the request has other places, and bodies only come with some methods
    asks = F.col("method").isin("post", "put", "patch", "delete")
    read = F.filter("requested", lambda p: asks | ~p["location"].isin("body", "form", "file"))
    plain = F.when(F.col("framework") == "fastapi", F.col("parameters")).otherwise(F.concat(F.filter("parameters", lambda p: p["location"] == "path"), F.coalesce(read, F.array().cast(f"array<{_PARAMETER}>"))))
    rows = rows.withColumn("parameters", completed(plain))
    success = F.coalesce(F.col("status"), F.lit(200)).cast("string")
    statuses = F.when((F.col("framework") == "fastapi") & (F.size("parameters") > 0), F.array_sort(F.array_distinct(F.array(success, F.lit("422"))))).otherwise(F.array(success))
    return rows.select("repo_id", "service", "framework", "path", "method", "operation_id", "function", "file", "line", "summary", "tags", "parameters", statuses.alias("statuses"), "duplicate")


def warnings(operations: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, code, file, line, message): routes left out as duplicates and files that could not be parsed."""
    twice = operations.where("duplicate").select("repo_id", F.lit("W005").alias("code"), "file", "line", F.concat_ws(" ", F.lit("duplicate"), F.upper("method"), "path").alias("message"))
    broken = facts.where("kind = 'error'").select("repo_id", F.lit("W101").alias("code"), F.col("path").alias("file"), "line", F.get_json_object("value", "$.message").alias("message"))
    return twice.unionByName(broken).distinct()


def documents(operations: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(repo_id, service, document): one OpenAPI 3.1 document a service, as JSON with sorted keys."""
    rows = operations.where("NOT duplicate")
    outside = F.filter("parameters", lambda p: ~p["location"].isin("body", "form", "file"))
    parameters = F.transform(outside, lambda p: F.struct(p["location"].alias("in"), p["name"].alias("name"), p["required"].alias("required"), F.struct(p["type"].alias("type")).alias("schema")))
    inside = F.filter("parameters", lambda p: p["location"].isin("body", "form", "file"))
    media = F.when(F.exists(inside, lambda p: p["location"] == "file"), "multipart/form-data").when(F.exists(inside, lambda p: p["location"] == "form"), "application/x-www-form-urlencoded").otherwise("application/json")
    body = F.when(F.size(inside) > 0, F.struct(F.create_map(media, F.struct(F.struct(F.lit("object").alias("type")).alias("schema"))).alias("content"), F.exists(inside, lambda p: p["required"]).alias("required")))
    responses = F.map_from_entries(F.transform("statuses", lambda s: F.struct(s, F.struct(F.when(s == "422", "Validation Error").when(s == "201", "Created").when(s == "204", "No Content").otherwise("OK").alias("description")))))
    operation = F.struct(F.col("operation_id").alias("operationId"), F.when(F.size(outside) > 0, parameters).alias("parameters"), body.alias("requestBody"), responses.alias("responses"), F.col("summary"), F.when(F.size("tags") > 0, F.array_sort("tags")).alias("tags"))
    per_path = rows.select("repo_id", "service", "path", F.struct("method", operation.alias("o")).alias("m")).groupBy("repo_id", "service", "path").agg(F.map_from_entries(F.array_sort(F.collect_list("m"), lambda a, b: F.when(a["method"] < b["method"], -1).when(a["method"] > b["method"], 1).otherwise(0))).alias("item"))
    per_service = per_path.groupBy("repo_id", "service").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "item")), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))).alias("paths"))
    info = F.struct(F.col("service").alias("title"), F.lit("0.1.0").alias("version"))
    return per_service.select("repo_id", "service", F.to_json(F.struct(info.alias("info"), F.lit("3.1.0").alias("openapi"), "paths")).alias("document"))


def gates(operations: DataFrame, documents: DataFrame) -> DataFrame:
    """(repo_id, service, gate, passed): names are unique, path parameters declared, and documents hold exactly the operations."""
    rows = operations.where("NOT duplicate")
    named = rows.groupBy("repo_id", "service").agg((F.count("*") == F.countDistinct("operation_id")).alias("passed")).withColumn("gate", F.lit("unique_operation_ids"))
    open_ = F.array_except(F.regexp_extract_all("path", F.lit("\\{(\\w+)\\}"), F.lit(1)), F.transform(F.filter("parameters", lambda p: (p["location"] == "path") & p["required"]), lambda p: p["name"]))
    declared = rows.groupBy("repo_id", "service").agg(F.bool_and(F.size(open_) == 0).alias("passed")).withColumn("gate", F.lit("path_params_declared"))
    in_document = documents.select("repo_id", "service", F.explode(F.from_json(F.get_json_object("document", "$.paths"), "map<string,map<string,string>>")).alias("path", "item")).select("repo_id", "service", "path", F.explode(F.map_keys("item")).alias("method"))
    own = rows.select("repo_id", "service", "path", "method")
    services = rows.select("repo_id", "service").distinct()
    lacking = lambda a, b, gate: services.join(a.join(b, ["repo_id", "service", "path", "method"], "left_anti").select("repo_id", "service").distinct().withColumn("bad", F.lit(True)), ["repo_id", "service"], "left").select("repo_id", "service", F.lit(gate).alias("gate"), F.col("bad").isNull().alias("passed"))
    out = named.select("repo_id", "service", "gate", "passed").unionByName(declared.select("repo_id", "service", "gate", "passed"))
    return out.unionByName(lacking(own, in_document, "endpoint_coverage")).unionByName(lacking(in_document, own, "no_invented_operations"))
