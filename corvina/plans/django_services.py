"""From facts of URL configurations to operations: inclusions are followed by joins, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.schemas import REF
from ..operators.storage import cut
from . import contracts

_ACTION = "struct<action:string,method:string,detail:boolean,extra:string>"


def _of(facts: DataFrame, kind: str, schema: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).withColumn("v", F.from_json("value", schema)).select("repo_id", "path", "module", "line", "v.*")


def _route(route: Column, regex: Column) -> Column:
    """A segment as plain text: anchors go, named groups and typed parameters become {name}."""
    plain = F.regexp_replace(F.regexp_replace(route, r"\(\?P<(\w+)>[^()]*(?:\([^()]*\)[^()]*)*\)", "{$1}"), r"^\^|\$$", "")
    return F.when(regex, F.regexp_replace(plain, r"\\([./-])", "$1")).otherwise(F.regexp_replace(route, r"<(?:[^:<>]+:)?(\w+)>", "{$1}"))


def mounts(facts: DataFrame) -> DataFrame:
    """(repo_id, service, module, prefix): each URL module below the root of a settings file, once for each prefix."""
    now = _of(facts, "settings", "root string").select("repo_id", F.element_at(F.split("root", "\\."), 1).alias("service"), F.col("root").alias("module"), F.lit("").alias("prefix"), F.array("root").alias("seen"))
    includes = _of(facts, "url_include", "route string, regex boolean, target string, router string").where("router IS NULL")
    includes = includes.select(F.col("repo_id").alias("i_repo"), F.col("module").alias("i_module"), "target", _route(F.col("route"), F.col("regex")).alias("i_prefix"))
    includes = cut(includes)
    found = now = cut(now)
    while True:
        step = now.join(includes, (F.col("repo_id") == F.col("i_repo")) & (F.col("module") == F.col("i_module"))).where(~F.array_contains("seen", F.col("target")))
        now = step.select("repo_id", "service", F.col("target").alias("module"), F.concat("prefix", "i_prefix").alias("prefix"), F.concat("seen", F.array("target")).alias("seen"))
        now = cut(now)
        if now.isEmpty():
            break
        found = found.unionByName(now)
    return found.select("repo_id", "service", "module", "prefix").distinct()


def _rows(facts: DataFrame) -> DataFrame:
    """Every route with what handles it; a service is the package of a settings file's root module."""
    mounted = mounts(facts)
    views = _of(facts, "view", f"name string, methods array<string>, lookup string, actions array<{_ACTION}>, serializer_module string, serializer string").select("serializer_module", "serializer", "repo_id", F.col("module").alias("view_module"), F.col("name").alias("view"), F.col("path").alias("file"), F.col("line").alias("view_line"), "methods", "lookup", "actions")
    urls = _of(facts, "url", "route string, regex boolean, view_module string, view string").join(mounted, ["repo_id", "module"]).join(views, ["repo_id", "view_module", "view"])
    plain = urls.select("repo_id", "service", F.concat("prefix", _route(F.col("route"), F.col("regex"))).alias("raw"), F.explode("methods").alias("method"), F.col("view").alias("function"), "file", F.col("view_line").alias("line"), "serializer_module", "serializer")
    registered = _of(facts, "register", "router string, route string, view_module string, view string").drop("path", "line")
    routers = _of(facts, "url_include", "route string, regex boolean, target string, router string").where("router IS NOT NULL").select("repo_id", "module", "router", _route(F.col("route"), F.col("regex")).alias("at"))
    sets = registered.join(routers, ["repo_id", "module", "router"]).join(mounted, ["repo_id", "module"]).join(views, ["repo_id", "view_module", "view"]).withColumn("a", F.explode("actions"))
    one = F.concat("prefix", "at", F.col("route"), F.lit("/"), F.when(F.col("a.detail"), F.concat(F.lit("{"), "lookup", F.lit("}/"))).otherwise(""), F.when(F.col("a.extra") != "", F.concat("a.extra", F.lit("/"))).otherwise(""))
    acted = sets.select("repo_id", "service", one.alias("raw"), F.col("a.method").alias("method"), F.col("a.action").alias("function"), "file", F.col("view_line").alias("line"), "serializer_module", "serializer")
    return plain.unionByName(acted).withColumn("path", F.regexp_replace(F.concat(F.lit("/"), "raw"), "/{2,}", "/"))


def bodies(operations: DataFrame, facts: DataFrame, typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((repo_id, service, path, method, request, response) by the views' serializers; (repo_id, schema_id) that partial updates take). typed are the facts of python_types."""
    key = ["repo_id", "service", "path", "method"]
    rows = _rows(facts).where("serializer IS NOT NULL").join(operations.where("framework = 'django' AND NOT duplicate").select(*key, "file", "line", "function"), [*key, "file", "line", "function"])
    refs = rows.select("repo_id", F.col("file").alias("path"), F.col("serializer_module").alias("module"), F.col("serializer").alias("name"))
    classes = contracts._of(typed, "class", "name string")
    found = contracts.resolved(refs, classes, typed).select("repo_id", F.col("path").alias("file"), F.col("module").alias("serializer_module"), F.col("name").alias("serializer"), F.col("key").alias("schema_id"))
    rows = cut(rows.join(found, ["repo_id", "file", "serializer_module", "serializer"]).dropDuplicates(key))
    ref = lambda more="": F.concat(F.lit('{"$ref": "' + REF), "schema_id", F.lit(more + '"}'))
    taken = F.when(F.col("method") == "patch", ref(":partial")).when(F.col("method").isin("post", "put"), ref())
    listed = (F.col("function") == "list") | (F.col("method") == "get") & ~F.col("path").contains("{") & F.col("function").rlike("List")
    given = F.when(F.col("method") == "delete", F.lit(None)).when(listed, F.concat(F.lit('{"items":'), ref(), F.lit(',"type":"array"}'))).otherwise(ref())
    return rows.select(*key, taken.alias("request"), given.alias("response")), rows.where("method = 'patch'").select("repo_id", "schema_id")


def operations(facts: DataFrame) -> DataFrame:
    """The same columns as services.operations()."""
    rows = _rows(facts)
    order = ["file", "line", "function"]
    rows = rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("repo_id", "service", "path", "method").orderBy(*order)) > 1)
    rows = rows.withColumn("base", paths.operation_base(F.col("method"), F.col("path")))
    n = F.row_number().over(Window.partitionBy("repo_id", "service", "base").orderBy("duplicate", "path", "method", *order))
    parameters = F.transform(F.regexp_extract_all("path", F.lit("\\{(\\w+)\\}"), F.lit(1)), lambda p: F.struct(p.alias("name"), F.lit("path").alias("location"), F.lit(True).alias("required"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("ref")))
    # what a view with a serializer takes
    body = F.when(F.col("serializer").isNotNull() & F.col("method").isin("post", "put", "patch"), F.array(F.struct(F.lit("body").alias("name"), F.lit("body").alias("location"), (F.col("method") != "patch").alias("required"), F.lit("object").alias("type"), F.col("serializer").alias("ref")))).otherwise(F.array().cast("array<struct<name:string,location:string,required:boolean,type:string,ref:string>>"))
    parameters = F.concat(parameters, body)
    status = F.when(F.col("function") == "create", "201").when(F.col("function") == "destroy", "204").otherwise("200")
    statuses = F.when(F.col("path").contains("{"), F.array(status, F.lit("404"))).otherwise(F.array(status))
    return rows.select("repo_id", "service", F.lit("django").alias("framework"), "path", "method", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string"))).alias("operation_id"), "function", "file", "line", F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("tags"), parameters.alias("parameters"), statuses.alias("statuses"), "duplicate")
