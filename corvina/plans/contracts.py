"""What operations take, answer and ask for: class schemas, error statuses along calls, security, and whole documents.

Inheritance, calls, dependencies and references between schemas are edge tables, followed by joins level by level.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http, paths
from ..operators import relational
from ..operators.schemas import REF
from ..operators.storage import cut

#: Levels of calls below a route in which exceptions count, and of dependencies. Inheritance and references are followed to their ends.
CALLS, DEPENDENCIES = 4, 2
_TARGET = "struct<module:string,name:string>"
_CLASS = f"name string, type string, bases array<{_TARGET}>, fields array<struct<name:string,schema:string,required:boolean,position:int>>, whole string, meta struct<module:string,name:string,fields:array<string>,exclude:array<string>,read_only:array<string>>, closed boolean, description string"
_FUNCTION = f"name string, raises array<struct<status:int,module:string,name:string,detail:string,line:int>>, calls array<{_TARGET}>, depends array<{_TARGET}>, returns string, inputs array<struct<name:string,schema:string>>"
_REFERENCE = r'"\$ref": ?"' + REF + r'([^"]+)"'


def _of(facts: DataFrame, kind: str, schema: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).withColumn("v", F.from_json("value", schema)).select("repo_id", "path", "module", "line", "v.*")


def resolved(refs: DataFrame, definitions: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, path, module, name, key): the definition (repo_id, path, module, name), as its path:name, that a reference (repo_id, path, module, name) means.

    A module is named from any directory above its package; of several, the one that shares most leading directories with the file that refers to it, then the smallest path. Names that modules pass on from others count, however often they are passed on.
    """
    alias = _of(facts, "alias", "name string, target_module string, target string").select("repo_id", F.col("module").alias("a_module"), F.col("name").alias("a_name"), "target_module", "target").distinct()
    alias = cut(alias)
    wanted = cut(refs.select("repo_id", "path", "module", "name").distinct())
    last = seen = cut(_suffixes(definitions.select("repo_id", "module", "name", F.col("path").alias("r_path"), F.col("name").alias("r_name"))).distinct())
    while True:
        passed = alias.join(last.select("repo_id", F.col("module").alias("target_module"), F.col("name").alias("target"), "r_path", "r_name"), ["repo_id", "target_module", "target"])
        more = _suffixes(passed.select("repo_id", F.col("a_module").alias("module"), F.col("a_name").alias("name"), "r_path", "r_name"))
        last = cut(more.distinct().join(seen, seen.columns, "left_anti"))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    hit = wanted.join(seen, ["repo_id", "module", "name"])
    shared = F.size(F.filter(F.zip_with(F.split("path", "/"), F.split("r_path", "/"), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    first = relational.keep_first(hit.withColumn("_shared", shared), ["repo_id", "path", "module", "name"], [F.desc("_shared"), "r_path", "r_name"])
    return cut(first.select("repo_id", "path", "module", "name", F.concat_ws(":", "r_path", "r_name").alias("key")))


def _suffixes(rows: DataFrame) -> DataFrame:
    parts = F.split("module", "\\.")
    return rows.withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))))


def _closure(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo_id, root, node, depth): nodes within depth steps (at any distance where it is None) of each start(repo_id, root) along edges(repo_id, a, b), with the fewest steps."""
    last = found = cut(start.select("repo_id", "root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    edges = cut(edges.select("repo_id", F.col("a").alias("node"), "b"))
    for k in itertools.count(1) if depth is None else range(1, depth + 1):
        step = last.join(edges, ["repo_id", "node"]).select("repo_id", "root", F.col("b").alias("node"))
        last = cut(step.distinct().join(found, ["repo_id", "root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def _edges(rows: DataFrame, targets: str, definitions: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, a, b, position): what each of rows(path, name) refers to in its array of targets."""
    refs = rows.select("repo_id", "path", F.concat_ws(":", "path", "name").alias("a"), F.posexplode(targets).alias("position", "t")).select("repo_id", "path", "a", "position", "t.module", "t.name")
    return refs.join(resolved(refs, definitions, facts), ["repo_id", "path", "module", "name"]).select("repo_id", "a", F.col("key").alias("b"), "position")


def schemas(facts: DataFrame) -> DataFrame:
    """(repo_id, schema_id, title, type, schema JSON): one schema a class; a subclass has the fields of its bases, its own ones win. References name schema_ids; one to an unknown class is gone, which leaves {}."""
    classes = _of(facts, "class", _CLASS).withColumn("key", F.concat_ws(":", "path", "name"))
    classes = cut(relational.keep_first(classes, ["repo_id", "key"], [F.desc("line")]))
    edges = _edges(classes, "bases", classes, facts)
    up = _closure(edges, classes.select("repo_id", F.col("key").alias("root")))
    own = classes.select("repo_id", F.col("key").alias("node"), "path", "type", "fields", "whole")
    lines = up.join(own, ["repo_id", "node"])
    kind = lines.groupBy("repo_id", "root").agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("depth"))).alias("type"))
    fields = lines.select("repo_id", "root", "depth", "node", "path", F.explode("fields").alias("f")).select("repo_id", "root", "depth", "node", "path", "f.*")
    fields = cut(relational.keep_first(fields.unionByName(_model_fields(classes, lines, facts)), ["repo_id", "root", "name"], ["depth", "node", "position"]))
    # references inside fields, found once for each
    refs = fields.select("repo_id", "path", F.explode(F.regexp_extract_all("schema", F.lit(_REFERENCE), F.lit(1))).alias("ref"))
    refs = refs.select("repo_id", "path", "ref", F.element_at(F.split("ref", ":"), 1).alias("module"), F.element_at(F.split("ref", ":"), 2).alias("name")).distinct()
    known = refs.join(resolved(refs, classes, facts), ["repo_id", "path", "module", "name"], "left").groupBy("repo_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("ref", F.coalesce("key", F.lit("")).alias("key")))).alias("known"))
    fields = fields.join(known, ["repo_id", "path"], "left").withColumn("schema", _rewritten(F.col("schema"), F.col("known")))
    entry = F.concat("name", F.lit(":"), "schema")
    order = F.struct((-F.col("depth")).alias("depth"), "node", "position", entry.alias("entry"))
    parts = fields.groupBy("repo_id", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["entry"]), ",").alias("properties"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("required"), F.col("name")))), ",").alias("required"))
    whole = classes.select("repo_id", F.col("key").alias("root"), F.element_at(F.split("name", "\\."), -1).alias("title"), "whole", "closed", "description").join(kind, ["repo_id", "root"]).join(parts, ["repo_id", "root"], "left")
    object_ = F.concat(F.lit('{"properties":{'), F.coalesce("properties", F.lit("")), F.lit("}"), F.when(F.col("required") != "", F.concat(F.lit(',"required":['), "required", F.lit("]"))).otherwise(""), F.when(F.col("closed"), F.lit(',"additionalProperties":false')).otherwise(""), F.when(F.col("description").isNotNull(), F.concat(F.lit(',"description":'), _quoted(F.col("description")))).otherwise(""), F.lit(',"type":"object"}'))
    return whole.select("repo_id", F.col("root").alias("schema_id"), "title", "type", F.coalesce("whole", object_).alias("schema"))


def _model_fields(classes: DataFrame, lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Fields that serializers take from their models: below all declared ones, the key first; of named ones only those."""
    metas = classes.where("meta IS NOT NULL").select("repo_id", F.col("key").alias("root"), "path", F.col("meta.module").alias("module"), F.col("meta.name").alias("name"), "meta")
    found = metas.join(resolved(metas, classes, facts), ["repo_id", "path", "module", "name"]).select("repo_id", "root", F.col("key").alias("model"), "meta")
    models = lines.select("repo_id", F.col("root").alias("model"), "depth", "node", "path", F.explode("fields").alias("f")).select("repo_id", "model", "depth", "node", "path", "f.*")
    key = found.select("repo_id", "model").distinct().select("repo_id", "model", F.lit(500).alias("depth"), F.col("model").alias("node"), F.element_at(F.split("model", ":"), 1).alias("path"), F.lit('"id"').alias("name"), F.lit('{"readOnly": true, "type": "integer"}').alias("schema"), F.lit(False).alias("required"), F.lit(-1).alias("position"))
    rows = found.join(models.unionByName(key), ["repo_id", "model"]).withColumn("plain", F.trim("name", F.lit('"')))
    named = F.coalesce(F.array_contains("meta.fields", F.col("plain")), F.col("meta.fields").isNull())
    rows = rows.where(named & ~F.array_contains("meta.exclude", F.col("plain")))
    read = F.array_contains("meta.read_only", F.col("plain"))
    shown = F.when(read & ~F.col("schema").contains('"readOnly"'), F.regexp_replace("schema", r"^\{", '{"readOnly": true, ')).otherwise(F.col("schema"))
    return rows.select("repo_id", "root", (F.col("depth") + 1000).alias("depth"), "node", "path", "name", shown.alias("schema"), (F.col("required") & ~read).alias("required"), "position")


def partial(schemas: DataFrame, wanted: DataFrame) -> DataFrame:
    """Schemas of wanted(repo_id, schema_id) as what a partial update takes: nothing is required."""
    rows = schemas.join(wanted.select("repo_id", "schema_id").distinct(), ["repo_id", "schema_id"], "left_semi")
    return rows.withColumns({"schema_id": F.concat("schema_id", F.lit(":partial")), "title": F.concat(F.lit("Patched"), "title"), "schema": F.regexp_replace("schema", r',"required":\[[^\]]*\]', "")})


def _rewritten(schema: Column, known: Column) -> Column:
    """A schema with each reference of the map renamed; references that are not known go."""
    entries = F.coalesce(F.map_entries(known), F.array().cast("array<struct<key:string,value:string>>"))
    step = lambda s, e: F.replace(s, F.concat(F.lit(f'"$ref": "{REF}'), e["key"], F.lit('"')), F.when(e["value"] == "", F.lit("")).otherwise(F.concat(F.lit(f'"$ref": "{REF}'), e["value"], F.lit('"'))))
    return F.aggregate(entries, schema, step)


def _functions(facts: DataFrame) -> DataFrame:
    rows = _of(facts, "function", _FUNCTION).withColumn("key", F.concat_ws(":", "path", "name"))
    return cut(relational.keep_first(rows, ["repo_id", "key"], [F.desc("line")]))


def errors(operations: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, status, detail, confidence): statuses of exceptions that a route or what it calls raises, each once; high confidence for the route's own, medium below. Exceptions without a status take that of their handler."""
    functions = _functions(facts)
    edges = _edges(functions, "calls", functions, facts).unionByName(_edges(functions, "depends", functions, facts)).select("repo_id", "a", "b").distinct()
    roots = operations.where("NOT duplicate").select("repo_id", "service", "path", "method", F.concat_ws(":", "file", "function").alias("root"))
    reached = _closure(edges, roots.select("repo_id", "root"), CALLS)
    raised = functions.select("repo_id", F.col("key").alias("node"), F.col("path").alias("r_path"), F.explode("raises").alias("r")).select("repo_id", "node", F.col("r_path").alias("path"), "r.*")
    classes = _of(facts, "class", _CLASS)
    handled = _of(facts, "handler", "exception_module string, exception string, status int").where("status IS NOT NULL").select("repo_id", "path", F.col("exception_module").alias("module"), F.col("exception").alias("name"), F.col("status").alias("h_status"))
    by_class = handled.join(resolved(handled, classes, facts), ["repo_id", "path", "module", "name"]).groupBy("repo_id", "key").agg(F.min("h_status").alias("h_status"))
    own = resolved(raised.where("status IS NULL"), classes, facts)
    raised = raised.join(own, ["repo_id", "path", "module", "name"], "left").join(by_class, ["repo_id", "key"], "left")
    raised = raised.select("repo_id", "node", F.coalesce("status", "h_status").alias("status"), "detail", "line").where("status IS NOT NULL")
    rows = roots.join(reached, ["repo_id", "root"]).join(raised, ["repo_id", "node"])
    first = relational.keep_first(rows, ["repo_id", "service", "path", "method", "status"], ["depth", "node", "line"])
    return first.select("repo_id", "service", "path", "method", F.col("status").cast("string").alias("status"), "detail", F.when(F.col("depth") == 0, "high").otherwise("medium").alias("confidence"))


def security(operations: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, scheme_name, scheme JSON): schemes that a route's dependencies reach; ones that lack what a document must state are left out."""
    functions = _functions(facts).select("repo_id", "path", "module", "name", "depends")
    schemes = _of(facts, "scheme", "name string, scheme string")
    targets = functions.select("repo_id", "path", "module", "name").unionByName(schemes.select("repo_id", "path", "module", "name"))
    edges = _edges(functions, "depends", targets, facts).select("repo_id", "a", "b").distinct()
    roots = operations.where("NOT duplicate").select("repo_id", "service", "path", "method", F.concat_ws(":", "file", "function").alias("root"))
    reached = _closure(edges, roots.select("repo_id", "root"), DEPENDENCIES + 1)
    named = schemes.where("scheme IS NOT NULL").select("repo_id", F.concat_ws(":", "path", "name").alias("node"), F.col("name").alias("scheme_name"), "scheme")
    return roots.join(reached, ["repo_id", "root"]).join(named, ["repo_id", "node"]).select("repo_id", "service", "path", "method", "scheme_name", "scheme").distinct()


def bodies(operations: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, request JSON, response JSON): schemas of the one body parameter (of several, an object of them) and of the answer."""
    functions = _functions(facts).select("repo_id", "path", F.col("key").alias("root"), "returns", "inputs")
    refs = functions.select("repo_id", "path", F.explode(F.regexp_extract_all(F.concat_ws(" ", "returns", F.array_join(F.col("inputs.schema"), " ")), F.lit(_REFERENCE), F.lit(1))).alias("ref"))
    refs = refs.select("repo_id", "path", "ref", F.element_at(F.split("ref", ":"), 1).alias("module"), F.element_at(F.split("ref", ":"), 2).alias("name")).distinct()
    known = refs.join(resolved(refs, _of(facts, "class", _CLASS), facts), ["repo_id", "path", "module", "name"], "left").groupBy("repo_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("ref", F.coalesce("key", F.lit("")).alias("key")))).alias("known"))
    rows = operations.where("NOT duplicate").select("repo_id", "service", "path", "method", F.concat_ws(":", "file", "function").alias("root"), "parameters")
    rows = rows.join(functions.withColumnRenamed("path", "f_path"), ["repo_id", "root"]).join(known.withColumnRenamed("path", "f_path"), ["repo_id", "f_path"], "left")
    names = F.transform(F.filter("parameters", lambda p: p["location"].isin("body", "form", "file")), lambda p: p["name"])
    inside = F.filter("inputs", lambda i: F.array_contains(names, i["name"]))
    several = F.concat(F.lit('{"properties":{'), F.array_join(F.transform(inside, lambda i: F.concat(F.lit('"'), i["name"], F.lit('":'), i["schema"])), ","), F.lit('},"type":"object"}'))
    request = F.when(F.size(inside) == 1, F.get(inside, 0)["schema"]).when(F.size(inside) > 1, several)
    return rows.select("repo_id", "service", "path", "method", _rewritten(request, F.col("known")).alias("request"), _rewritten(F.col("returns"), F.col("known")).alias("response"))


def component_names(schemas: DataFrame) -> DataFrame:
    """schemas with the name of each in documents: its title, followed by the start of a hash where an earlier schema of the repository has the title."""
    n = F.row_number().over(Window.partitionBy("repo_id", "title").orderBy("schema_id"))
    safe = F.regexp_replace("title", "[^A-Za-z0-9._-]", "_")
    return schemas.withColumn("name", F.when(n == 1, safe).otherwise(F.concat_ws("_", safe, F.substring(F.sha2("schema_id", 256), 1, 8))))


# Answers that most operations have, with what asks for them.
USUAL = {"401": "secured", "403": "secured", "404": "templated", "500": "any"}


def usual_answers(rows: DataFrame, secured: DataFrame) -> DataFrame:
    """Answers that operations have by convention: those of signed-in users where there is security, 404 where the path has parameters, 500 anywhere."""
    key = ["repo_id", "service", "path", "method"]
    marked = rows.select(*key).join(secured.select(*key).distinct().withColumn("_s", F.lit(True)), key, "left")
    holds = {"secured": F.col("_s").isNotNull(), "templated": F.col("path").contains("{"), "any": F.lit(True)}
    found = F.filter(F.array(*[F.when(holds[when], F.lit(status)) for status, when in USUAL.items()]), lambda x: x.isNotNull())
    return marked.select(*key, F.explode(found).alias("status"), F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("detail"))


def _servers(operations: DataFrame, servers: list[dict]) -> DataFrame:
    """(repo_id, service, servers JSON): the given servers, without a path that all paths of the service begin with."""
    common = paths.common_prefix(operations.where("NOT duplicate"), ["repo_id", "service"])
    parts = []
    for s in servers:
        at = paths.url_path(F.lit(s["url"]))
        short = F.when(http.server_matches(at, F.col("prefix")), F.expr("substring(u, 1, length(u) - length(a))")).otherwise(F.col("u"))
        common = common.withColumns({"u": F.lit(s["url"]), "a": at}).withColumn(f"s{len(parts)}", F.when(short == "", "/").otherwise(short))
        parts.append(F.struct(F.lit(s.get("description")).cast("string").alias("description"), F.col(f"s{len(parts)}").alias("url")))
    return common.select("repo_id", "service", F.to_json(F.array(*parts)).alias("servers") if parts else F.lit(None).cast("string").alias("servers"))


def _object(entries: list[tuple[str, Column]]) -> Column:
    """A JSON object of the entries that are not null."""
    parts = F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in entries])
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda x: x.isNotNull()), ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def parts(operations: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """The schemas, bodies, errors and security of Python operations, in the form that assemble() takes."""
    return {"schemas": schemas(facts), "bodies": bodies(operations, facts), "errors": errors(operations, facts).select("repo_id", "service", "path", "method", "status", "detail", F.lit(None).cast("string").alias("response")), "security": security(operations, facts)}


def joined_parts(*every: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The parts of several languages as one."""
    out = dict(every[0])
    for more in every[1:]:
        out = {k: out[k].unionByName(more[k]) for k in out}
    return out


def documents(operations: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, service, document): one OpenAPI 3.1 document a service of Python operations."""
    return assemble(operations, parts(operations, facts))


def assemble(operations: DataFrame, parts: dict[str, DataFrame], conventional: bool = False, servers: list[dict] | None = None, internal: list[str] | None = None) -> DataFrame:
    """(repo_id, service, document): one OpenAPI 3.1 document a service, with the component schemas that its operations reach.

    conventional adds responses that most operations have, where they state none of their status; servers (url, description) come without the path that all operations share; operations below internal paths are left out.
    """
    key = ["repo_id", "service", "path", "method"]
    operations = cut(operations.where(~paths.is_internal(F.col("path"), internal or [])))
    own = cut(component_names(parts["schemas"]))
    rows = operations.where("NOT duplicate").join(parts["bodies"], key, "left")
    declared = rows.select(*key, F.explode("statuses").alias("status"), "response").withColumn("response", F.when((F.col("status") < "300") & (F.col("status") != "204") & ~F.col("response").isin("{}", '{"type": "null"}'), F.col("response"))).withColumn("detail", F.lit(None).cast("string"))
    secured = cut(parts["security"])
    answers = declared.unionByName(parts["errors"].select(*key, "status", "response", "detail").join(operations.where("NOT duplicate").select(*key), key, "left_semi"))
    if conventional:
        answers = answers.unionByName(usual_answers(rows, secured))
    answers = relational.keep_first(answers, [*key, "status"], [F.col("detail").isNull(), F.col("response").isNull()])
    one = F.concat(_quoted(F.col("status")), F.lit(":"), _object([("content", F.concat(F.lit('{"application/json":{"schema":'), "response", F.lit("}}"))), ("description", _quoted(F.coalesce("detail", http.status_phrase(F.col("status")))))]))
    answers = answers.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(http.status_rank(F.col("status")).alias("r"), "status", one.alias("o")))), lambda x: x["o"]), ",").alias("answers"))
    asked = secured.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("{"), _quoted(F.col("scheme_name")), F.lit(":[]}")))), ",").alias("asked"))
    rows = rows.join(answers, key, "left").join(asked, key, "left")
    outside = F.filter("parameters", lambda p: ~p["location"].isin("body", "form", "file"))
    parameters = F.when(F.size(outside) > 0, F.to_json(F.transform(outside, lambda p: F.struct(p["location"].alias("in"), p["name"].alias("name"), p["required"].alias("required"), F.struct(p["type"].alias("type")).alias("schema")))))
    inside = F.filter("parameters", lambda p: p["location"].isin("body", "form", "file"))
    media = F.when(F.exists(inside, lambda p: p["location"] == "file"), "multipart/form-data").when(F.exists(inside, lambda p: p["location"] == "form"), "application/x-www-form-urlencoded").otherwise("application/json")
    body = F.when(F.size(inside) > 0, F.concat(F.lit('{"content":{"'), media, F.lit('":{"schema":'), F.coalesce("request", F.lit('{"type":"object"}')), F.lit('}},"required":'), F.exists(inside, lambda p: p["required"]).cast("string"), F.lit("}")))
    operation = _object([("operationId", _quoted(F.col("operation_id"))), ("parameters", parameters), ("requestBody", body), ("responses", F.concat(F.lit("{"), "answers", F.lit("}"))), ("security", F.when(F.col("asked").isNotNull(), F.concat(F.lit("["), "asked", F.lit("]")))), ("summary", F.when(F.col("summary").isNotNull(), _quoted(F.col("summary")))), ("tags", F.when(F.size("tags") > 0, F.to_json(F.array_sort("tags"))))])
    rows_tags = rows.groupBy("repo_id", "service").agg(F.to_json(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))), lambda t: F.struct(t.alias("name")))).alias("all_tags"))
    rows = cut(rows.select(*key, operation.alias("operation")))
    joined = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), v.alias("v")))), lambda x: F.concat(_quoted(x["k"]), F.lit(":"), x["v"])), ",")
    items = rows.groupBy("repo_id", "service", "path").agg(F.concat(F.lit("{"), joined(F.col("method"), F.col("operation")), F.lit("}")).alias("item"), F.concat_ws(" ", F.collect_list("operation")).alias("all"))
    whole = items.groupBy("repo_id", "service").agg(joined(F.col("path"), F.col("item")).alias("paths"), F.concat_ws(" ", F.collect_list("all")).alias("all"))
    # component schemas: what operations refer to, and what those refer to
    links = own.select("repo_id", F.col("schema_id").alias("a"), F.explode(F.array_distinct(F.regexp_extract_all("schema", F.lit(_REFERENCE), F.lit(1)))).alias("b"))
    first = whole.select("repo_id", "service", F.explode(F.array_distinct(F.regexp_extract_all("all", F.lit(_REFERENCE), F.lit(1)))).alias("root"))
    used = first.join(_closure(links, first), ["repo_id", "root"]).select("repo_id", "service", F.col("node").alias("schema_id")).distinct().join(own, ["repo_id", "schema_id"])
    parts = used.groupBy("repo_id", "service").agg(joined(F.col("name"), F.col("schema")).alias("components"), F.map_from_entries(F.collect_set(F.struct("schema_id", "name"))).alias("names"))
    declared = secured.select("repo_id", "service", "scheme_name", "scheme").distinct().groupBy("repo_id", "service").agg(joined(F.col("scheme_name"), F.col("scheme")).alias("schemes"))
    whole = whole.join(parts, ["repo_id", "service"], "left").join(declared, ["repo_id", "service"], "left")
    within = F.when(F.col("components").isNotNull() | F.col("schemes").isNotNull(), _object([("schemas", F.concat(F.lit("{"), "components", F.lit("}"))), ("securitySchemes", F.concat(F.lit("{"), "schemes", F.lit("}")))]))
    tagged = rows_tags.join(whole.select("repo_id", "service"), ["repo_id", "service"], "right")
    whole = whole.join(tagged, ["repo_id", "service"]).join(_servers(operations, servers or []), ["repo_id", "service"], "left")
    document = _object([("components", within), ("info", F.concat(F.lit('{"title":'), _quoted(F.col("service")), F.lit(',"version":"0.1.0"}'))), ("openapi", F.lit('"3.1.0"')), ("paths", F.concat(F.lit("{"), "paths", F.lit("}"))), ("servers", F.col("servers")), ("tags", F.when(F.col("all_tags") != "[]", F.col("all_tags")))])
    pointed = F.aggregate(F.coalesce(F.map_entries("names"), F.array().cast("array<struct<key:string,value:string>>")), document, lambda s, e: F.replace(s, F.concat(F.lit(f'"{REF}'), e["key"], F.lit('"')), F.concat(F.lit('"#/components/schemas/'), e["value"], F.lit('"'))))
    return whole.select("repo_id", "service", pointed.alias("document"))
