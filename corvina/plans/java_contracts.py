"""What operations of Java controllers take, answer and ask for: types resolved by joins, schemas of classes with their type arguments, exceptions along calls, filter chains, context paths.

A name is resolved by an equi join of its candidates (itself, an import, its package, wildcards, a nested type, a unique simple name) with the declared types, the first candidate wins. Types with arguments are followed from operations by joins, level by level, until no new one is met; each schema is made by one call on its own row.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import java_types as jt
from ..functions.yaml_text import load
from ..functions.arrow import arrow_function
from ..operators import relational
from ..operators.storage import cut

#: Rounds of calls below an operation in which exceptions count.
CALLS = 4
_NOTE = "struct<name:string,line:int,value:string,arguments:map<string,string>>"
_PARAMETER = f"struct<name:string,type:string,annotations:array<{_NOTE}>>"
_METHOD = f"struct<name:string,line:int,returns:string,annotations:array<{_NOTE}>,parameters:array<{_PARAMETER}>,body:string,throws:array<struct<type:string,arguments:string,line:int>>,calls:array<struct<owner:string,name:string>>>"
_FIELD = f"struct<name:string,type:string,annotations:array<{_NOTE}>>"
TYPE = f"package string, imports array<string>, wildcards array<string>, name string, qualified string, form string, annotations array<{_NOTE}>, parameters array<string>, extends string, components array<{_FIELD}>, fields array<{_FIELD}>, methods array<{_METHOD}>"
# The keys that name the path below which a service answers.
CONTEXT_KEYS = {"spring": "server.servlet.context-path", "spring-webflux": "spring.webflux.base-path"}
# Annotations that ask for a signed-in user.
GUARDS = ["PreAuthorize", "Secured", "RolesAllowed"]
_KEY = ["repo_id", "service", "path", "method"]
_NAME = r"([A-Za-z_$][\w$.]*)"


def index(types: DataFrame) -> DataFrame:
    """The declared types, one row for each qualified name of a repository: of several, the last file's."""
    rows = types.withColumn("v", F.from_json("value", TYPE)).select("repo_id", F.col("path").alias("file"), "line", "value", "v.*")
    return cut(relational.keep_first(rows, ["repo_id", "qualified"], [F.desc("file"), F.desc("line")]))


def names(types: DataFrame) -> DataFrame:
    """(repo_id, owner, name): the type names that each type's declaration uses."""
    of = lambda texts: F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(_NAME), F.lit(1))))
    texts = F.concat(F.array(F.coalesce("extends", F.lit(""))), F.col("fields.type"), F.col("components.type"), F.col("methods.returns"), F.flatten(F.transform("methods", lambda m: m["parameters"]["type"])), F.flatten(F.transform("methods", lambda m: m["throws"]["type"])))
    # handled exceptions are named by annotations
    said = F.flatten(F.transform("methods", lambda m: F.flatten(F.transform(F.filter(m["annotations"], lambda a: a["name"] == "ExceptionHandler"), lambda a: F.split(F.regexp_replace(F.coalesce(a["value"], a["arguments"]["value"], F.lit("")), r"\.class|[{}\s]", ""), ",")))))
    return types.select("repo_id", F.col("qualified").alias("owner"), F.explode(F.array_distinct(F.concat(of(texts), said))).alias("name")).where("name <> ''")


def resolved(refs: DataFrame, types: DataFrame) -> DataFrame:
    """(repo_id, owner, name, qualified): the declared type that a name (repo_id, owner, name) means in the type `owner`."""
    context = types.select("repo_id", F.col("qualified").alias("owner"), "package", "imports", "wildcards")
    rows = refs.distinct().join(context, ["repo_id", "owner"])
    name = F.col("name")
    inside = F.filter("imports", lambda i: F.element_at(F.split(i, "\\."), -1) == name)
    package = F.when(F.col("package") == "", name).otherwise(F.concat_ws(".", "package", name))
    candidates = F.concat(F.array(name), inside, F.array(package), F.transform("wildcards", lambda w: F.concat_ws(".", w, name)), F.array(F.concat_ws(".", "owner", name)))
    tried = rows.select("repo_id", "owner", "name", F.posexplode(candidates).alias("at", "qualified"))
    hit = tried.join(types.select("repo_id", "qualified"), ["repo_id", "qualified"]).groupBy("repo_id", "owner", "name").agg(F.min_by("qualified", "at").alias("qualified"))
    simple = types.groupBy("repo_id", F.element_at(F.split("qualified", "\\."), -1).alias("name")).agg(F.count("*").alias("n"), F.min("qualified").alias("only")).where("n = 1").drop("n")
    out = rows.select("repo_id", "owner", "name").join(hit, ["repo_id", "owner", "name"], "left").join(simple, ["repo_id", "name"], "left")
    return out.select("repo_id", "owner", "name", F.coalesce("qualified", "only").alias("qualified")).where("qualified IS NOT NULL")


def known_names(types: DataFrame) -> DataFrame:
    """(repo_id, qualified, known map): for each type, what the names in its declaration mean."""
    rows = resolved(names(types), types)
    return cut(rows.groupBy("repo_id", F.col("owner").alias("qualified")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", F.col("qualified").alias("value"))))).alias("known")))


def _map(entries: list[dict] | None) -> dict[str, str]:
    return {e["key"]: e["value"] for e in entries or []}


def _made(batches):
    """Schemas of instances: (value, arguments JSON, known, parent value, known of the parent)."""
    for b in batches:
        out = []
        for repo, name, value, arguments, known, parent, above in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
            schema, c = jt.class_schema(json.loads(value), json.loads(arguments), _map(known), json.loads(parent) if parent else None, _map(above))
            out.append((repo, name, json.dumps(schema), c.level, c.reason, [{"schema_id": k, "qualified": q, "arguments": json.dumps(a)} for k, (q, a) in c.references.items()]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.string()] * 5 + [pa.list_(pa.struct([("schema_id", pa.string()), ("qualified", pa.string()), ("arguments", pa.string())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["repo_id", "schema_id", "schema", "level", "reason", "references"])


def schemas(types: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, schema_id, title, schema JSON, level, reason) of wanted(repo_id, schema_id, qualified, arguments JSON) and all that they refer to."""
    base = types.withColumn("above", F.regexp_extract(F.coalesce("extends", F.lit("")), r"^([\w$.]+)", 1))
    parents = base.join(known, ["repo_id", "qualified"], "left").withColumn("parent", F.try_element_at("known", F.col("above")))
    values = types.select("repo_id", F.col("qualified").alias("parent"), F.col("value").alias("parent_value"))
    above = known.select("repo_id", F.col("qualified").alias("parent"), F.col("known").alias("parent_known"))
    rows = cut(parents.where("parent IS NULL OR parent <> qualified").unionByName(parents.where("parent = qualified").withColumn("parent", F.lit(None).cast("string"))).join(values, ["repo_id", "parent"], "left").join(above, ["repo_id", "parent"], "left").select("repo_id", "qualified", "value", F.map_entries("known").alias("known"), "parent_value", F.map_entries("parent_known").alias("parent_known")))
    last, seen = cut(wanted.select("repo_id", "schema_id", "qualified", "arguments").dropDuplicates(["repo_id", "schema_id"])), None
    ids = last.select("repo_id", "schema_id")
    schema = "repo_id string, schema_id string, schema string, level string, reason string, references array<struct<schema_id:string,qualified:string,arguments:string>>"
    while not last.isEmpty():
        made = cut(last.join(rows, ["repo_id", "qualified"]).select("repo_id", "schema_id", "value", "arguments", "known", "parent_value", "parent_known").mapInArrow(_made, schema))
        seen = made if seen is None else seen.unionByName(made)
        more = made.select("repo_id", F.explode("references").alias("r")).select("repo_id", "r.*").dropDuplicates(["repo_id", "schema_id"])
        last = cut(more.join(ids, ["repo_id", "schema_id"], "left_anti"))
        ids = ids.unionByName(last.select("repo_id", "schema_id"))
    if seen is None:
        return types.sparkSession.createDataFrame([], "repo_id string, schema_id string, title string, schema string, level string, reason string")
    title = F.element_at(F.split(F.element_at(F.split("schema_id", "__of__"), 1), "\\."), -1)
    arguments = F.regexp_replace(F.regexp_extract("schema_id", "__of__(.*)$", 1), r"(?:[\w]+\.)+", "")
    return seen.select("repo_id", "schema_id", F.concat_ws("", title, F.regexp_replace(arguments, "__and__|__of__", "")).alias("title"), "schema", "level", "reason")


def _methods(types: DataFrame) -> DataFrame:
    """(repo_id, file, qualified, name, line, m): the methods of all types, overloads apart."""
    return types.select("repo_id", "file", "qualified", F.explode("methods").alias("m")).select("repo_id", "file", "qualified", F.col("m.name").alias("name"), F.col("m.line").alias("line"), "m")


def _note(notes: Column, *wanted: str) -> Column:
    return F.get(F.filter(notes, lambda a: a["name"].isin(*wanted)), 0)


def _status(text: Column) -> Column:
    """The number of a status by its name, or null."""
    codes = F.create_map(*[F.lit(x) for pair in jt.STATUSES.items() for x in pair])
    last = F.element_at(F.split(F.trim(text), "\\."), -1)
    return F.coalesce(F.when(last.rlike("^[1-5][0-9]{2}$"), F.try_to_number(last, F.lit("999")).cast("int")), codes[last])


def _declared(notes: Column) -> Column:
    """The status that an annotation states."""
    a = _note(notes, "ResponseStatus")
    return _status(F.coalesce(a["value"], a["arguments"]["value"], a["arguments"]["code"]))


@arrow_function("struct<status:int,created:boolean,empty:boolean>")
def _built(body: pa.Array) -> pa.Array:
    found = [jt.built(x or "") for x in body.to_pylist()]
    return pa.array([{"status": s, "created": c, "empty": e} for s, c, e in found], pa.struct([("status", pa.int32()), ("created", pa.bool_()), ("empty", pa.bool_())]))


_CONVERTED = "struct<schema:string,level:string,reason:string,references:array<struct<schema_id:string,qualified:string,arguments:string>>>"


@arrow_function(_CONVERTED)
def _converted(text: pa.Array, known: pa.Array) -> pa.Array:
    out = []
    for t, k in zip(text.to_pylist(), known.to_pylist(), strict=True):
        c = jt.Converter(_map(k))
        schema = c.convert(t) if t is not None else None
        out.append({"schema": None if schema is None else json.dumps(schema), "level": c.level, "reason": c.reason, "references": [{"schema_id": i, "qualified": q, "arguments": json.dumps(a)} for i, (q, a) in c.references.items()]})
    kind = pa.struct([("schema", pa.string()), ("level", pa.string()), ("reason", pa.string()), ("references", pa.list_(pa.struct([("schema_id", pa.string()), ("qualified", pa.string()), ("arguments", pa.string())])))])
    return pa.array(out, kind)


def methods_of(operations: DataFrame, types: DataFrame) -> DataFrame:
    """operations with the type (owner) and method m that handles each."""
    own = _methods(types).withColumnRenamed("name", "function")
    rows = operations.where("NOT duplicate").join(own.withColumnRenamed("line", "m_line"), ["repo_id", "file", "function"])
    # of overloads the one that begins closest before or at the mapping's line
    far = F.abs(F.col("m_line") - F.col("line"))
    return relational.keep_first(rows, _KEY, [far, "m_line"]).withColumnRenamed("qualified", "owner")


def _with_names(handled: DataFrame, known: DataFrame, *texts: Column) -> DataFrame:
    """handled with what the names in the given type texts mean in the owner. These names alone are looked up: a type has as many names as handlers, so no row may carry them all."""
    said = F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(_NAME), F.lit(1)) for t in texts]))
    meant = known.select("repo_id", F.col("qualified").alias("owner"), F.explode("known").alias("key", "value"))
    found = handled.select(*_KEY, "owner", F.explode(said).alias("key")).join(meant, ["repo_id", "owner", "key"])
    return handled.join(found.groupBy(*_KEY).agg(F.collect_list(F.struct("key", "value")).alias("names")), _KEY, "left")


def bodies(handled: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, status, created, request, response, level, reason, references): what a handler takes as its body and answers. A response is null where there is no content."""
    body = F.get(F.filter("m.parameters", lambda p: F.exists(p["annotations"], lambda a: a["name"] == "RequestBody") | (F.size(p["annotations"]) == 0) & (F.col("framework") == "jaxrs")), 0)["type"]
    rows, names = _with_names(handled, known, body, F.col("m.returns")), F.col("names")
    rows = rows.select(*_KEY, "framework", F.col("m.returns").alias("returns"), _declared(F.col("m.annotations")).alias("declared"), _built(F.col("m.body")).alias("built"), _converted(body, names).alias("taken"), _converted(F.col("m.returns"), names).alias("given"))
    inner = F.regexp_extract("returns", r"([\w$.]+)>*$", 1)
    nothing = F.col("returns").rlike(r"^(?:(?:[\w$]+\.)*(?:ResponseEntity|HttpEntity|Mono|CompletableFuture|CompletionStage|Callable|DeferredResult)<)*(?:void|Void|\?)>*$")
    void = F.when(F.col("framework") == "jaxrs", 204).otherwise(200)
    status = F.coalesce("declared", "built.status", F.when(nothing, void).otherwise(200))
    empty = nothing | (F.col("declared").isNull() & F.col("built.empty")) | (status == 204)
    shown = F.when(~empty & ~inner.isin("Response", "ServerResponse"), F.col("given.schema"))
    none = F.array().cast("array<struct<schema_id:string,qualified:string,arguments:string>>")
    return rows.select(*_KEY, status.cast("string").alias("status"), F.col("built.created").alias("created"), F.col("taken.schema").alias("request"), shown.alias("response"), F.when(empty, "medium").otherwise(F.col("given.level")).alias("level"), F.when(empty, "inferred_return_flow").otherwise(F.col("given.reason")).alias("reason"), F.concat(F.coalesce("taken.references", none), F.when(shown.isNotNull(), F.col("given.references")).otherwise(none)).alias("references"))


def calls(types: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, owner, method, b_owner, b_method): methods that a method calls, its own type's and those of its fields' types."""
    rows = _methods(types).select("repo_id", "qualified", F.col("name").alias("method"), F.explode("m.calls").alias("c")).distinct()
    own = rows.where("c.owner IN ('', 'this')").select("repo_id", "qualified", "method", F.col("qualified").alias("b_owner"), F.col("c.name").alias("b_method"))
    fields = types.select("repo_id", "qualified", F.explode(F.concat("fields", "components")).alias("f")).join(known, ["repo_id", "qualified"])
    fields = fields.select("repo_id", "qualified", F.col("f.name").alias("field"), F.try_element_at("known", F.regexp_extract("f.type", r"^([\w$.]+)", 1)).alias("b_owner")).where("b_owner IS NOT NULL")
    injected = rows.select("repo_id", "qualified", "method", F.col("c.owner").alias("field"), F.col("c.name").alias("b_method")).join(fields, ["repo_id", "qualified", "field"]).drop("field")
    every = own.unionByName(injected)
    real = _methods(types).select("repo_id", F.col("qualified").alias("b_owner"), F.col("name").alias("b_method")).distinct()
    return cut(every.join(real, ["repo_id", "b_owner", "b_method"]).withColumnRenamed("qualified", "owner").distinct())


def advice(types: DataFrame) -> DataFrame:
    """(repo_id, advisor, exception, status, returns): what handlers of whole applications make of exceptions, by their simple names."""
    rows = types.where(F.exists("annotations", lambda a: a["name"].isin("ControllerAdvice", "RestControllerAdvice"))).select("repo_id", F.col("qualified").alias("advisor"), F.explode("methods").alias("m"))
    rows = rows.withColumn("a", _note(F.col("m.annotations"), "ExceptionHandler")).where("a IS NOT NULL")
    named = F.split(F.regexp_replace(F.coalesce("a.value", F.col("a.arguments")["value"], F.lit("")), r"\.class|[{}\s]", ""), ",")
    status = F.coalesce(_declared(F.col("m.annotations")), _status(F.nullif(F.regexp_extract("m.body", r"HttpStatus\.([A-Z_]+)", 1), F.lit(""))))
    return rows.select("repo_id", "advisor", F.explode(named).alias("exception"), status.alias("status"), F.col("m.returns").alias("returns"), F.col("m.line").alias("line")).withColumn("exception", F.element_at(F.split("exception", "\\."), -1))


def mappers(types: DataFrame) -> DataFrame:
    """(repo_id, exception, status): what JAX-RS exception mappers answer."""
    rows = _methods(types).where("name = 'toResponse'").select("repo_id", F.get("m.parameters", 0)["type"].alias("exception"), _status(F.nullif(F.regexp_extract("m.body", r"Status\.([A-Z_]+)|status\(\s*(\d{3})", 1), F.lit(""))).alias("named"), F.regexp_extract("m.body", r"status\(\s*(\d{3})", 1).alias("plain"))
    return rows.select("repo_id", F.element_at(F.split("exception", "\\."), -1).alias("exception"), F.coalesce("named", F.try_to_number("plain", F.lit("999")).cast("int")).alias("status")).where("status IS NOT NULL")


def errors(handled: DataFrame, types: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, status, exception, returns, advisor): the statuses of exceptions that a handler or what it calls throws, each once; JAX-RS looks at the handler alone."""
    edges = calls(types, known)
    now = found = cut(handled.select(*_KEY, "framework", "owner", F.col("function").alias("method_"), F.lit(0).alias("depth")))
    for k in range(1, CALLS + 1):
        step = now.where("framework <> 'jaxrs'").join(edges.withColumnRenamed("method", "method_"), ["repo_id", "owner", "method_"])
        step = step.select(*_KEY, "framework", F.col("b_owner").alias("owner"), F.col("b_method").alias("method_")).distinct()
        now = cut(step.join(found, [*_KEY, "owner", "method_"], "left_anti").withColumn("depth", F.lit(k)))
        if now.isEmpty():
            break
        found = found.unionByName(now)
    thrown = _methods(types).select("repo_id", F.col("qualified").alias("owner"), F.col("name").alias("method_"), F.explode("m.throws").alias("t"))
    rows = found.join(thrown, ["repo_id", "owner", "method_"]).withColumn("exception", F.element_at(F.split(F.regexp_extract("t.type", r"^([\w$.]+)", 1), "\\."), -1))
    # what the exception's own class states
    stated = types.select("repo_id", F.col("qualified").alias("e_type"), _declared(F.col("annotations")).alias("stated")).where("stated IS NOT NULL")
    meant = known.select("repo_id", F.col("qualified").alias("owner"), F.explode("known").alias("exception_", "e_type")).select("repo_id", "owner", F.element_at(F.split("exception_", "\\."), -1).alias("exception"), "e_type").dropDuplicates(["repo_id", "owner", "exception"])
    rows = rows.join(meant, ["repo_id", "owner", "exception"], "left").join(stated, ["repo_id", "e_type"], "left")
    advised = relational.keep_first(advice(types).where("status IS NOT NULL"), ["repo_id", "exception"], ["advisor", "line"]).select("repo_id", "exception", F.col("status").alias("a_status"), "returns", "advisor")
    mapped = mappers(types).groupBy("repo_id", "exception").agg(F.min("status").alias("m_status"))
    rows = rows.join(advised, ["repo_id", "exception"], "left").join(mapped, ["repo_id", "exception"], "left")
    own = F.when(F.col("exception") == "ResponseStatusException", _status(F.nullif(F.regexp_extract("t.arguments", r"HttpStatus\.([A-Z_]+)", 1), F.lit(""))))
    web = F.create_map(*[F.lit(x) for pair in jt.WEB_EXCEPTIONS.items() for x in pair])
    said = F.when(F.col("exception") == "WebApplicationException", _status(F.nullif(F.regexp_extract("t.arguments", r"Status\.([A-Z_]+)", 1), F.lit(""))))
    status = F.when(F.col("framework") == "jaxrs", F.coalesce(web[F.col("exception")], said, "m_status")).when(F.col("exception") == "ResponseStatusException", own).otherwise(F.coalesce("stated", "a_status"))
    by_advice = (F.col("framework") != "jaxrs") & F.col("stated").isNull() & (F.col("exception") != "ResponseStatusException")
    rows = rows.select(*_KEY, status.cast("string").alias("status"), "exception", F.when(by_advice, F.col("returns")).alias("returns"), F.when(by_advice, F.col("advisor")).alias("advisor"), "depth", F.col("t.line").alias("line")).where("status IS NOT NULL")
    return relational.keep_first(rows, [*_KEY, "status"], ["depth", "line", "exception"]).drop("depth", "line")


def validated(handled: DataFrame) -> DataFrame:
    """Operations whose handler has a parameter that is checked on its way in."""
    return handled.where(F.exists("m.parameters", lambda p: F.exists(p["annotations"], lambda a: a["name"].isin("Valid", "Validated")))).select(*_KEY)


@arrow_function("struct<scheme_name:string,scheme:string,open:array<string>,guarded:array<string>,every:boolean>")
def _chain(body: pa.Array, owner: pa.Array) -> pa.Array:
    out = []
    for b, o in zip(body.to_pylist(), owner.to_pylist(), strict=True):
        found = jt.scheme(b or "", o or "")
        open_, guarded, every = jt.rules(b or "")
        out.append(None if found is None else {"scheme_name": found[0], "scheme": json.dumps(found[1]), "open": [jt.ant_pattern(p) for p in open_], "guarded": [jt.ant_pattern(p) for p in guarded], "every": every})
    return pa.array(out, pa.struct([("scheme_name", pa.string()), ("scheme", pa.string()), ("open", pa.list_(pa.string())), ("guarded", pa.list_(pa.string())), ("every", pa.bool_())]))


def _roots(path: Column) -> Column:
    """The directories above a file, the repository's own ("") included, with how deep each is."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("deep"), F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("root")))


def module_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, file, root): the deepest module root above each file, "" without one."""
    above = files.select("repo_id", "file").distinct().select("repo_id", "file", F.explode(_roots(F.col("file"))).alias("r")).select("repo_id", "file", "r.*")
    hit = above.join(modules.select("repo_id", "root").distinct(), ["repo_id", "root"]).groupBy("repo_id", "file").agg(F.max_by("root", "deep").alias("root"))
    return files.select("repo_id", "file").distinct().join(hit, ["repo_id", "file"], "left").fillna("", ["root"])


def chains(types: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, root, scheme_name, scheme, open, guarded, every): the filter chains with a scheme that their text proves, by the module that holds them."""
    rows = _methods(types).where(F.col("m.returns").startswith("SecurityFilterChain")).withColumn("c", _chain(F.col("m.body"), F.col("qualified"))).where("c IS NOT NULL")
    rows = rows.select("repo_id", "file", "line", "c.*").join(module_of(rows, modules), ["repo_id", "file"])
    return relational.keep_first(rows, ["repo_id", "root"], ["file", "line"]).drop("file", "line")


def security(handled: DataFrame, types: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, service, path, method, scheme_name, scheme): operations that the nearest chain above their module, or the only one, guards. Paths that it opens are never guarded."""
    found = cut(chains(types, modules))
    single = found.groupBy("repo_id").agg(F.count("*").alias("n"), F.first("root").alias("only")).where("n = 1").drop("n")
    rows = handled.join(module_of(handled, modules), ["repo_id", "file"])
    above = rows.select(*_KEY, F.explode(_roots(F.concat("root", F.lit("/x")))).alias("r")).select(*_KEY, "r.deep", F.regexp_replace("r.root", "^/", "").alias("root")).distinct()
    nearest = above.join(found.select("repo_id", "root"), ["repo_id", "root"]).groupBy(*_KEY).agg(F.max_by("root", "deep").alias("nearest"))
    rows = rows.drop("root").join(nearest, _KEY, "left").join(single, "repo_id", "left").withColumn("root", F.coalesce("nearest", "only"))
    owner = types.select("repo_id", F.col("qualified").alias("owner"), F.col("annotations").alias("t_annotations"))
    rows = rows.join(owner, ["repo_id", "owner"]).join(found, ["repo_id", "root"])
    hit = lambda patterns: F.exists(patterns, lambda p: F.rlike(F.col("path"), p))
    marked = F.exists(F.concat("m.annotations", "t_annotations"), lambda a: a["name"].isin(GUARDS))
    return rows.where(~hit("open") & (marked | F.col("every") | hit("guarded"))).select(*_KEY, "scheme_name", "scheme")


def context_paths(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo_id, root, key, prefix): the path below which a module's applications answer, from its first configuration file that states one."""
    wanted = files.where(F.col("path").rlike(r"(^|/)application[\w-]*\.(properties|ya?ml)$"))
    rows = wanted.select("repo_id", F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    def read(batches):
        for b in batches:
            out = [(r, f, k, v) for r, f, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for k in CONTEXT_KEYS.values() if (v := setting(f, t, k))]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["repo_id", "file", "key", "prefix"])

    found = rows.mapInArrow(read, "repo_id string, file string, key string, prefix string")
    found = found.join(module_of(rows, modules), ["repo_id", "file"])
    return relational.keep_first(found, ["repo_id", "root", "key"], ["file"]).drop("file")


def setting(file: str, text: str, key: str) -> str | None:
    """The text at a dotted key of a properties file or of nested blocks of a YAML file."""
    if file.endswith(".properties"):
        pairs = (x.strip().partition("=") for x in text.splitlines())
        return next((v.strip() for k, _, v in pairs if k.strip() == key), None)
    node = load(text)
    for part in key.split("."):
        node = node.get(part) if isinstance(node, dict) else None
    return node if isinstance(node, str) else None


#: What errors look like where no handler says so.
ENVELOPE = {"type": "object", "properties": {"timestamp": {"type": "string", "format": "date-time"}, "status": {"type": "integer"}, "error": {"type": "string"}, "message": {"type": "string"}, "path": {"type": "string"}}}
ENVELOPE_ID = "java.Error"


def envelopes(types: DataFrame, known: DataFrame) -> DataFrame:
    """(repo_id, envelope JSON, references): the one shape of errors: what handlers of whole applications answer, the last one with an error's name before others."""
    rows = advice(types).join(known.withColumnRenamed("qualified", "advisor"), ["repo_id", "advisor"], "left")
    rows = rows.withColumn("c", _converted(F.col("returns"), F.map_entries("known"))).where(F.col("c.schema").startswith('{"$ref"'))
    named = F.lower("c.schema").contains("error")
    order = F.struct(named.cast("int").alias("named"), F.when(named, 1).otherwise(-1).alias("way"), "advisor", "line")
    first = rows.groupBy("repo_id").agg(F.max_by(F.struct("c.schema", "c.references"), F.when(named, order)).alias("last"), F.min_by(F.struct("c.schema", "c.references"), F.struct("advisor", "line")).alias("first"))
    return first.select("repo_id", F.coalesce("last", "first").alias("e")).select("repo_id", F.col("e.schema").alias("envelope"), "e.references")


def application_paths(types: DataFrame) -> DataFrame:
    """(repo_id, application): the path of a JAX-RS application."""
    rows = types.withColumn("a", _note(F.col("annotations"), "ApplicationPath")).where("a IS NOT NULL")
    return rows.groupBy("repo_id").agg(F.min_by(F.coalesce("a.value", F.col("a.arguments")["value"]), "qualified").alias("application"))


def tag(owner: Column) -> Column:
    """The tag of a controller: its simple name without the usual ending."""
    simple = F.element_at(F.split(owner, "\\."), -1)
    return F.lower(F.regexp_replace(simple, "(?<=.)(Controller|Resource|Api)$", ""))


def parts(operations: DataFrame, types: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """The schemas, bodies, errors, security and statuses of Java operations, in the form that contracts.assemble() takes."""
    types = index(types)
    known = known_names(types)
    handled = cut(methods_of(operations, types))
    own = cut(bodies(handled, known))
    failed = cut(errors(handled, types, known))
    shown = failed.join(known.withColumnRenamed("qualified", "advisor"), ["repo_id", "advisor"], "left").withColumn("c", _converted(F.col("returns"), F.map_entries("known")))
    envelope = cut(envelopes(types, known))
    none = F.array().cast("array<struct<schema_id:string,qualified:string,arguments:string>>")
    plain = F.lit(json.dumps({"$ref": jt.REF + ENVELOPE_ID}))
    shown = shown.join(envelope, "repo_id", "left").select(*_KEY, "status", F.when(F.col("c.schema").isNotNull() & (F.col("c.schema") != "{}"), F.col("c.schema")).otherwise(F.coalesce("envelope", plain)).alias("response"), F.when(F.col("c.schema").isNotNull() & (F.col("c.schema") != "{}"), F.col("c.references")).otherwise(F.coalesce("references", none)).alias("references"))
    checked = validated(handled).join(envelope, "repo_id", "left").select(*_KEY, F.lit("400").alias("status"), F.coalesce("envelope", plain).alias("response"), F.coalesce("references", none).alias("references"))
    shown = cut(relational.keep_first(shown.withColumn("o", F.lit(0)).unionByName(checked.withColumn("o", F.lit(1))), [*_KEY, "status"], ["o"]).drop("o"))
    wanted = own.select("repo_id", F.explode("references").alias("r")).unionByName(shown.select("repo_id", F.explode("references").alias("r"))).select("repo_id", "r.*")
    made = schemas(types, known, wanted).select("repo_id", "schema_id", "title", F.lit("java").alias("type"), "schema")
    extra = shown.where(F.col("response") == plain).select("repo_id").distinct().select("repo_id", F.lit(ENVELOPE_ID).alias("schema_id"), F.lit("Error").alias("title"), F.lit("java").alias("type"), F.lit(json.dumps(ENVELOPE)).alias("schema"))
    return {
        "schemas": made.unionByName(extra),
        "bodies": own.select(*_KEY, "request", "response"),
        "statuses": own.select(*_KEY, F.array("status").alias("statuses"), "created"),
        "errors": shown.select(*_KEY, "status", F.lit(None).cast("string").alias("detail"), "response"),
        "security": security(handled, types, modules),
    }
