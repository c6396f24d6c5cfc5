"""Queries that run the operators of contracts over the driver's tables, and the same in DuckDB SQL: each fails if its operator is broken."""

from __future__ import annotations

import http as standard

from pyspark.sql import functions as F

from .functions import http, java_types, python_facts
from .functions import text as texts
from .operators import relational
from .operators.schemas import hashed
from .operators.storage import cut
from .plans import contracts, enrichment, java_contracts, java_services, report, services, sinks, validation
from .queries import _PATH, _SEGMENTS, ORACLES, QUERIES, _query, _read, paths, url_path
from .sources import tree

_STATUS = ", ".join(f"('{s.value}', '{s.phrase.replace(chr(39), chr(39) * 2)}')" for s in standard.HTTPStatus)
_CODE = "CASE p_partkey % 7 WHEN 0 THEN 'default' WHEN 1 THEN CAST(p_partkey % 6 AS VARCHAR) || 'XX' ELSE CAST(90 + p_partkey % 450 AS VARCHAR) END"


def _codes(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE.replace("VARCHAR", "STRING")).alias("code"))


@_query(f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part), s(v, phrase) AS (VALUES {_STATUS})
  SELECT p_partkey, CASE WHEN code = 'default' THEN 'Unexpected error' WHEN code LIKE '_XX' THEN coalesce(CASE left(code, 1) WHEN '2' THEN 'Success' WHEN '3' THEN 'Redirection' WHEN '4' THEN 'Client error' WHEN '5' THEN 'Server error' END, 'Response')
    ELSE coalesce(phrase, 'Response') END AS phrase FROM c LEFT JOIN s ON code = v""")
def status_names(spark, sf_dir):
    return _codes(spark, sf_dir).select("p_partkey", http.status_phrase(F.col("code")).alias("phrase"))


@_query(f"""WITH c AS (SELECT p_partkey, p_brand, {_CODE} AS code FROM part)
  SELECT p_brand, array_to_string(list(code ORDER BY coalesce(try_cast(code AS INTEGER), 1000), code, p_partkey), ',') AS codes FROM c GROUP BY 1""")
def status_order(spark, sf_dir):
    rows = _codes(spark, sf_dir).join(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    ordered = F.array_sort(F.collect_list(F.struct(http.status_rank(F.col("code")).alias("r"), "code", "p_partkey")))
    return rows.groupBy("p_brand").agg(F.array_join(F.transform(ordered, lambda x: x["code"]), ",").alias("codes"))


@_query(f"""SELECT p_partkey, {_CODE} AS code FROM part WHERE NOT regexp_matches({_CODE}, '^([1-5][0-9][0-9]|[1-5]XX|default)$')""")
def response_keys(spark, sf_dir):
    return _codes(spark, sf_dir).where(~http.is_response_key(F.col("code")))


@_query("""SELECT conv_id, array_to_string(list(m ORDER BY coalesce(list_position(['get', 'put', 'post', 'delete', 'options', 'head', 'patch', 'trace'], m), 99), turn), ',') AS methods
  FROM (SELECT conv_id, turn, ['patch', 'get', 'link', 'delete', 'post'][CAST(turn % 5 + 1 AS BIGINT)] AS m FROM conversations) GROUP BY 1""")
def method_order(spark, sf_dir):
    method = F.element_at(F.array(*map(F.lit, ["patch", "get", "link", "delete", "post"])), (F.col("turn") % 5 + 1).cast("int"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", method.alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct(http.method_rank(F.col("m")).alias("r"), "turn", "m")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["m"]), ",").alias("methods"))


_ANTS = {"/en/**": "^/en(/.*)?$", "/*/1?": "^/[^/]*/1[^/]$", "/de/*": "^/de/[^/]*$", "/**/7": "^/.*/7$"}


@_query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), a(pattern, re) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _ANTS.items())})
  SELECT page_id, array_to_string(list(pattern ORDER BY pattern), ' ') AS patterns FROM p JOIN a ON regexp_matches(path, re) GROUP BY 1""")
def ant_match(spark, sf_dir):
    patterns = F.array_sort(F.array(*map(F.lit, _ANTS)))
    hit = F.filter(patterns, lambda p: F.rlike(F.col("path"), http.ant_pattern(p)))
    return url_path(spark, sf_dir).select("page_id", F.array_join(hit, " ").alias("patterns")).where("patterns <> ''")


@_query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '^(?:' || s_name || ')$' WHEN 1 THEN '^' || s_name || '$' WHEN 2 THEN '^' || s_name || '$' ELSE '^' || s_name || '$' END AS pattern FROM supplier""")
def anchored_patterns(spark, sf_dir):
    given = F.expr("CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN '^' || s_name WHEN 2 THEN s_name || '$' ELSE '^' || s_name || '$' END")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", http.anchored(given).alias("pattern"))


@_query(f"""SELECT page_id, path = '/en' OR starts_with(path, '/en/') OR starts_with('/en/', path || '/') AND path <> '' AS matches FROM (SELECT page_id, {_PATH} AS path FROM pages)""")
def server_prefix(spark, sf_dir):
    return url_path(spark, sf_dir).select("page_id", http.server_matches(F.col("path"), F.lit("/en")).alias("matches"))


@_query("""SELECT event_id, try_cast(regexp_extract(props, '^\\{"k": (-?[0-9]+)\\}$', 1) AS BIGINT) AS number, CASE WHEN regexp_matches(props, '^\\{"k": -?[0-9]+\\}$') THEN regexp_extract(props, '(-?[0-9]+)', 1) ELSE '"' || event_type || '"' END AS value FROM events""")
def coerced_defaults(spark, sf_dir):
    raw = F.coalesce(F.get_json_object("props", "$.k"), F.col("event_type"))
    return _read(spark, sf_dir, "events").select("event_id", http.number_of(raw, "bigint").alias("number"), http.coerced(raw, F.lit("integer")).alias("value"))


@_query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'application/x-' || lower(p_type) WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json' ELSE 'text/event-stream' END AS media FROM part""")
def media_types(spark, sf_dir):
    named = F.expr("CASE p_size % 4 WHEN 0 THEN '\"application/x-' || lower(p_type) || '\"' WHEN 1 THEN 'MediaType.TEXT_PLAIN_VALUE' WHEN 2 THEN p_name ELSE 'TEXT_EVENT_STREAM' END")
    return _read(spark, sf_dir, "part").select("p_partkey", http.media_type(named).alias("media"))


@_query("""SELECT c_custkey, regexp_replace(c_name || ' ' || c_mktsegment, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM customer""")
def component_titles(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", http.component_name(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("name"))


@_query("""SELECT item_id, trim(text, chr(10) || chr(13) || chr(9) || ' ') AS text FROM benchmark""")
def unfenced(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.trim("text", F.lit("\n\r\t ")), F.lit("\n```"))
    return _read(spark, sf_dir, "benchmark").select("item_id", http.unfenced(fenced).alias("text"))


@_query("""SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS summary, 'List ' || lower(p_type) AS listed FROM part""")
def summaries(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    told = enrichment.summary(F.lit("post"), F.lit("/x"), F.translate("p_name", " ", "_"))
    listed = enrichment.summary(F.lit("get"), F.concat(F.lit("/api/"), F.lower("p_type")), F.lit("index"))
    return part.select("p_partkey", told.alias("summary"), listed.alias("listed"))


@_query(f"""WITH s AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS service, {_SEGMENTS}[1] AS resource FROM pages)
  SELECT service, 'API for the ' || replace(service, '-', ' ') || '. Provides operations over: ' || array_to_string(list_sort(list_distinct(list(resource))), ', ') || '.' AS overview FROM s GROUP BY 1""")
def overviews(spark, sf_dir):
    return enrichment.overviews(_page_operations(spark, sf_dir)).select("service", "overview")


def _page_operations(spark, sf_dir):
    """Pages as operations: hosts as services, templates as paths."""
    path = paths.template(paths.url_path(F.col("url")))
    return _read(spark, sf_dir, "pages").select(F.lit("web").alias("repo_id"), F.regexp_extract("url", "://([^/]*)", 1).alias("service"), path.alias("path"), F.lit("get").alias("method"), F.lit(False).alias("duplicate")).distinct()


@_query(f"""WITH o AS (SELECT DISTINCT regexp_extract(url, '://([^/]*)', 1) AS service, '/' || array_to_string(list_transform({_SEGMENTS}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '{{id}}' ELSE x END), '/') AS path FROM pages)
  SELECT service, path, status FROM o, (VALUES ('401'), ('403'), ('404'), ('500')) u(status) WHERE status = '500' OR status = '404' AND contains(path, '{{') OR status IN ('401', '403') AND starts_with(path, '/de')""")
def usual_answers(spark, sf_dir):
    rows = _page_operations(spark, sf_dir)
    return contracts.usual_answers(rows, rows.where(F.col("path").startswith("/de"))).select("service", "path", "status")


@_query("""WITH m AS (SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 3000)
  SELECT n_name AS service, count(s_name) = 0 AS passed, coalesce(array_to_string(list_sort(list(s_name) FILTER (s_name IS NOT NULL))[1:5], '; '), '') AS detail FROM (SELECT n_name FROM nation) LEFT JOIN m USING (n_name) GROUP BY 1""")
def gate_details(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation")
    bad = _read(spark, sf_dir, "supplier").where("s_acctbal < 3000").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    named = lambda rows: rows.select(F.lit("r").alias("repo_id"), F.col("n_name").alias("service"), *(["s_name"] if "s_name" in rows.columns else []))
    return validation.gate(named(nations), "balance", named(bad).withColumnRenamed("s_name", "message")).select("service", "passed", "detail")


@_query(f"""WITH p AS (SELECT page_id, substr({_PATH}, 2) AS file FROM pages), r AS (SELECT unnest(['en', 'de', 'de/1', '']) AS root)
  SELECT page_id, max_by(root, length(root)) AS root FROM p JOIN r ON starts_with(file, root || '/') OR root = '' GROUP BY 1""")
def nearest_module(spark, sf_dir):
    files = url_path(spark, sf_dir).select("page_id", F.lit("web").alias("repo_id"), F.expr("substring(path, 2)").alias("file"))
    roots = spark.createDataFrame([("web", r) for r in ("en", "de", "de/1", "")], "repo_id string, root string")
    return files.join(java_contracts.module_of(files, roots), ["repo_id", "file"]).select("page_id", "root")


@_query("""SELECT event_id, props, substr(sha256('["' || event_type || '"]'), 1, 4) AS mark FROM events""")
def canonical_props(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    # objects of one plain key are canonical but for their blanks
    return rows.select("event_id", F.regexp_replace(F.to_json(F.parse_json("props")), '^\\{"(\\w+)":', '{"$1": ').alias("props"), F.substring(F.sha2(F.to_json(F.array("event_type")), 256), 1, 4).alias("mark"))


def _schemas_of_parts(spark, sf_dir):
    """A schema for each part: titles differ, structures agree by brand and size."""
    part = _read(spark, sf_dir, "part")
    schema = F.concat(F.lit('{"type": "object", "title": "'), "p_name", F.lit('", "properties": {"'), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit('": {"type": "integer", "maximum": '), F.col("p_size").cast("string"), F.lit("}}}"))
    return part.select(F.lit("r").alias("repo_id"), F.col("p_partkey").cast("string").alias("schema_id"), F.col("p_brand").alias("title"), F.lit("s").alias("service"), schema.alias("schema"), "p_partkey")


_HASH = """substr(sha256('[{"properties":{"' || lower(replace(p_brand, '#', '')) || '":{"maximum":' || p_size || ',"type":"integer"}},"type":"object"}]'), 1, 16)"""


@_query(f"SELECT p_partkey, {_HASH} AS hash FROM part")
def schema_hash(spark, sf_dir):
    return hashed(_schemas_of_parts(spark, sf_dir)).select("p_partkey", "hash")


def _sources(spark, sf_dir, suffix, head, each):
    """One source file for each nation, with a piece for each of its suppliers, in order."""
    rows = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", each.alias("t")))), lambda x: x["t"]), "")
    # a stated number of partitions: few bytes of source are much work, and would else be read by one task
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "n_name")
    files = rows.groupBy("n_name").agg(F.concat(head, pieces, F.lit("}\n" if suffix == ".java" else "")).cast("binary").alias("content"))
    path = F.concat(F.lower("n_name"), F.lit(f"/app{suffix}"))
    return tree.kept(files.select(F.col("n_name").alias("repo_id"), path.alias("path"), F.octet_length("content").cast("long").alias("length"), "content"))


@_query("""SELECT n_name AS repo_id, '/suppliers/' || s_suppkey || '/{supplier_id}' AS path, 'put' AS method, 'putSuppliers' || s_suppkey || 'BySupplierId' AS operation_id, CAST('201' AS VARCHAR) || ',422' AS statuses
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def source_routes(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    each = F.concat(F.lit("@router.put('/"), key, F.lit("/{supplier_id:path}', status_code=201)\ndef put_"), key, F.lit("(supplier_id: int):\n    ...\n"))
    files = _sources(spark, sf_dir, ".py", F.lit("from fastapi import APIRouter, FastAPI\napp = FastAPI()\nrouter = APIRouter()\n"), each)
    files = files.withColumn("content", F.concat("content", F.lit("app.include_router(router, prefix='/suppliers')\n").cast("binary")))
    return services.operations(python_facts.facts(files)).select("repo_id", "path", "method", "operation_id", F.array_join("statuses", ",").alias("statuses"))


def _java_sources(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    each = F.concat(F.lit('  @GetMapping("/'), key, F.lit('") Box<S'), key, F.lit("> get"), key, F.lit("() { throw new Gone(); }\n  static class S"), key, F.lit(" { @Min("), key, F.lit(") int n; @JsonIgnore long no; }\n"))
    head = F.concat(F.lit("package a; @RestController @RequestMapping(\"/j\") class Api {\n  static class Box<T> { List<T> items; }\n  @ResponseStatus(HttpStatus.GONE) static class Gone extends RuntimeException {}\n"))
    return _sources(spark, sf_dir, ".java", head, each)


@_query("""SELECT n_name AS repo_id, '/j/' || s_suppkey AS path, '410' AS status, 'Gone' AS exception FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def java_errors(spark, sf_dir):
    from .functions import java_facts

    files = _java_sources(spark, sf_dir)
    operations = java_services.operations(java_facts.facts(files), tree.manifests(files))
    types = java_contracts.index(java_types.types(files))
    known = java_contracts.known_names(types)
    return java_contracts.errors(java_contracts.methods_of(operations, types), types, known).select("repo_id", "path", "status", "exception")


@_query("""WITH s AS (SELECT n_name AS repo_id, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT repo_id, 'java.a.Api.S' || k AS schema_id, '{"type": "object", "properties": {"n": {"type": "integer", "format": "int32", "minimum": ' || k || '}}}' AS schema FROM s UNION ALL
  SELECT repo_id, 'java.a.Api.Box__of__a.Api.S' || k, '{"type": "object", "properties": {"items": {"type": "array", "items": {"$ref": "#/schema_registry/schemas/java.a.Api.S' || k || '"}}}}' FROM s""")
def java_schemas(spark, sf_dir):
    from .functions import java_facts

    files = _java_sources(spark, sf_dir)
    operations = java_services.operations(java_facts.facts(files), tree.manifests(files))
    types = java_contracts.index(java_types.types(files))
    known = java_contracts.known_names(types)
    own = java_contracts.bodies(cut(java_contracts.methods_of(operations, types)), known)
    wanted = own.select("repo_id", F.explode("references").alias("r")).select("repo_id", "r.*")
    return java_contracts.schemas(types, known, wanted).select("repo_id", "schema_id", "schema")


@_query("""SELECT o_custkey AS service, array_to_string(list_filter([CASE WHEN count(*) FILTER (o_totalprice > 200000) > 1 THEN count(*) FILTER (o_totalprice > 200000) || ' unresolved' END,
    CASE WHEN round(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*), 4) < 0.5 THEN 'response completeness below 0.5' END,
    CASE WHEN count(*) FILTER (o_orderpriority LIKE '1%') > 0 THEN 'validation errors' END], lambda x: x IS NOT NULL), '; ') AS issues FROM orders GROUP BY 1""")
def production_issues(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("service")).agg(F.count_if(F.col("o_totalprice") > 200000).alias("unresolved"), texts.safe_ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("response_completeness"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("errors"))
    return rows.withColumns({"gates": F.lit(1), "gates_passed": F.lit(1)}).select("service", F.array_join(report.issues({"response_completeness": 0.5}, 1), "; ").alias("issues"))


@_query("""WITH d AS (SELECT n_nationkey, r_name, n_name, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT r_name AS repo_id, '[' || string_agg('{"id":"' || n_name || '","spec":"api.' || regexp_replace(n_name, '[^A-Za-z0-9_.-]+', '_', 'g') || '.json"}', ',' ORDER BY n_name) || ']' AS catalog FROM d WHERE n > 1 GROUP BY 1""")
def service_catalog(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sinks.catalog(sinks.service_paths(rows.select(F.col("r_name").alias("repo_id"), F.col("n_name").alias("service")), "api.json"))


@_query("""SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE k = 1""")
def first_by_key(spark, sf_dir):
    return relational.keep_first(_read(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "text")


__all__ = ["ORACLES", "QUERIES"]
