"""The facts of a repository as one canonical document, its JSON Schema, and checks of it when it is read."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http
from .sinks import canonical_json

VERSION = "1.0"
# The order of places of parameters.
PLACES = ["path", "query", "header", "cookie", "form", "file", "body"]


def _place(location: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, PLACES)), location).cast("int")
    return F.when(at > 0, at).otherwise(len(PLACES) + 1)


def documents(operations: DataFrame, statuses: DataFrame, secured: DataFrame, warnings: DataFrame) -> DataFrame:
    """(repo_id, metadata JSON): services by name, endpoints by path, operations by method, parameters by place and name, responses by status, security by scheme, warnings by code and place: equal facts give equal texts in whatever order they came."""
    key = ["repo_id", "service", "path", "method"]
    given = statuses.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(http.status_rank(F.col("status")).alias("r"), "status"))).alias("_s"))
    asked = secured.groupBy(*key).agg(F.array_sort(F.collect_set("scheme_name")).alias("security"))
    rows = operations.where("NOT duplicate").join(given, key, "left").join(asked, key, "left")
    parameters = F.transform(F.array_sort(F.transform("parameters", lambda p: F.struct(_place(p["location"]).alias("r"), p["name"].alias("name"), p["location"].alias("location"), p["required"].alias("required"), p["type"].alias("type")))), lambda p: F.struct(p["name"].alias("name"), p["location"].alias("location"), p["required"].alias("required"), p["type"].alias("type")))
    operation = F.struct(http.method_rank(F.col("method")).alias("r"), "method", F.col("operation_id"), F.concat_ws(":", "file", "function").alias("handler"), "line", parameters.alias("parameters"), F.transform(F.coalesce("_s", F.array().cast("array<struct<r:int,status:string>>")), lambda s: s["status"]).alias("responses"), F.coalesce("security", F.array().cast("array<string>")).alias("security"), F.array_sort("tags").alias("tags"), "summary")
    endpoints = rows.groupBy("repo_id", "service", "framework", "path").agg(F.transform(F.array_sort(F.collect_list(operation)), lambda o: o.dropFields("r")).alias("operations"))
    services = endpoints.groupBy("repo_id", "service").agg(F.min("framework").alias("framework"), F.array_sort(F.collect_list(F.struct("path", "operations"))).alias("endpoints"))
    whole = services.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(F.col("service").alias("id"), "framework", "endpoints"))).alias("services"))
    told = warnings.groupBy("repo_id").agg(F.array_sort(F.collect_set(F.struct("code", F.col("file"), F.col("line"), "message"))).alias("warnings"))
    out = whole.join(told, "repo_id", "left")
    none = F.array().cast("array<struct<code:string,file:string,line:int,message:string>>")
    return out.select("repo_id", _canonical(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col("repo_id").alias("repository"), "services", F.coalesce("warnings", none).alias("warnings")))).alias("metadata"))


def _canonical(text: Column) -> Column:
    def run(x: pa.Array) -> pa.Array:
        return pa.array([canonical_json(json.loads(t)) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def schema() -> dict:
    """The JSON Schema of metadata documents."""
    text, texts = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    thing = lambda needed, **p: {"type": "object", "properties": p, "required": needed, "additionalProperties": False}
    parameter = thing(["name", "location", "required"], name=text, location={"type": "string", "enum": PLACES}, required={"type": "boolean"}, type=text)
    operation = thing(["method", "operation_id", "parameters", "responses"], method={"type": "string", "enum": http.METHODS}, operation_id=text, handler=text, line={"type": "integer"}, parameters={"type": "array", "items": parameter}, responses=texts, security=texts, tags=texts, summary=text)
    endpoint = thing(["path", "operations"], path=text, operations={"type": "array", "items": operation})
    service = thing(["id", "framework", "endpoints"], id=text, framework=text, endpoints={"type": "array", "items": endpoint})
    warning = thing(["code", "message"], code=text, file=text, line={"type": "integer"}, message=text)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Metadata"} | thing(["version", "repository", "services", "warnings"], version=text, repository=text, services={"type": "array", "items": service}, warnings={"type": "array", "items": warning})


def problems(value, schema_: dict | None = None, at: str = "") -> list[str]:
    """Where a value does not follow the schema above (types, required and unknown keys, enumerations)."""
    schema_ = schema() if schema_ is None else schema_
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "boolean": bool}
    kind = kinds[schema_["type"]]
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        return [f"{at or '/'}: must be of type {schema_['type']}"]
    if "enum" in schema_ and value not in schema_["enum"]:
        return [f"{at}: {value!r} is not allowed"]
    out = []
    if kind is dict:
        own = schema_.get("properties", {})
        out += [f"{at}/{k}: is missing" for k in schema_.get("required", []) if k not in value]
        out += [f"{at}/{k}: is not known" for k in value if k not in own]
        for k, v in value.items():
            out += problems(v, own[k], f"{at}/{k}") if k in own else []
    if kind is list:
        for k, v in enumerate(value):
            out += problems(v, schema_["items"], f"{at}/{k}")
    return out


def load(path: str | Path) -> dict:
    """A metadata document; one that does not follow the schema is an error."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if found := problems(value):
        raise ValueError(f"{path}: {'; '.join(found[:5])}")
    return value
