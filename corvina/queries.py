"""Queries over the driver's tables, by name, and the same in DuckDB SQL.

Each shows one operator of the library on whole tables. Numbers are rounded or cast alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import graph, relational
from .plans import report

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
INTERNAL = ["/de", "/fr/1"]


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATH = "regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', '')"
_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_TEMPLATE = f"'/' || array_to_string(list_transform({_SEGMENTS}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '{{id}}' ELSE x END), '/')"


@_query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (l_discount > 0) AS BIGINT) AS n_discounted,
  CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
  round(CAST(count(*) FILTER (l_discount > 0) AS DOUBLE) / count(*), 4) AS discounted_ratio
  FROM lineitem GROUP BY ALL""")
def coverage(spark, sf_dir):
    hit = F.col("l_discount") > 0
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_lines"), F.count_if(hit).alias("n_discounted"), F.countDistinct("l_orderkey").alias("n_orders"),
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"), text.safe_ratio(F.count_if(hit), F.count("*")).alias("discounted_ratio"))


@_query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n_lines, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def coverage_rollup(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_lines"), F.grouping_id().cast("long").alias("level"))


@_query("""WITH h AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS signal FROM pages)
  SELECT signal, CAST(count(*) AS BIGINT) AS n_pages FROM h GROUP BY ALL""")
def signal_hits(spark, sf_dir):
    hits = _read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))).alias("signal"))
    return hits.groupBy("signal").agg(F.count("*").alias("n_pages"))


@_query("""SELECT regexp_extract(url, '^[a-z]+://[^/]*\\.([a-z]+)', 1) AS suffix, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY ALL""")
def ext_counts(spark, sf_dir):
    return _read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z]+)", 1).alias("suffix")).agg(F.count("*").alias("n"))


@_query(f"SELECT page_id, {_PATH} AS path FROM pages")
def url_path(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))


@_query(f"SELECT page_id, {_TEMPLATE} AS path FROM pages")
def path_template(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", paths.template(paths.url_path(F.col("url"))).alias("path"))


@_query(f"""WITH s AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, {_SEGMENTS} AS parts FROM pages),
  p AS (SELECT host, parts, generate_subscripts(parts, 1) AS pos FROM s),
  e AS (SELECT host, pos, parts[pos] AS part FROM p),
  t AS (SELECT host, count(*) AS n FROM s GROUP BY host),
  a AS (SELECT e.host, pos, min(part) AS part, count(DISTINCT part) = 1 AND count(*) = any_value(t.n) AS same FROM e JOIN t ON e.host = t.host GROUP BY e.host, pos),
  b AS (SELECT *, min(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY pos) AS ok FROM a)
  SELECT t.host, coalesce('/' || string_agg(part, '/' ORDER BY pos) FILTER (ok = 1), '') AS prefix FROM t LEFT JOIN b ON t.host = b.host GROUP BY t.host""")
def common_prefix(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), paths.url_path(F.col("url")).alias("path"))
    return paths.common_prefix(pages, ["host"])


@_query(f"""WITH s AS (SELECT page_id, 'get' || array_to_string(list_transform({_SEGMENTS}, lambda x:
    CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'ById' ELSE array_to_string(list_transform(list_filter(string_split_regex(x, '[^A-Za-z0-9]+'), lambda y: y <> ''), lambda y: upper(y[1]) || y[2:]), '') END), '') AS base FROM pages),
  n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS k FROM s)
  SELECT page_id, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS operation_id FROM n""")
def operation_ids(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", paths.operation_base(F.lit("GET"), paths.template(paths.url_path(F.col("url")))).alias("base"))
    return relational.unique_names(pages, "base", ["page_id"], "operation_id").select("page_id", "operation_id")


@_query(f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT * FROM p WHERE NOT (path = '/de' OR starts_with(path, '/de/') OR path = '/fr/1' OR starts_with(path, '/fr/1/'))")
def internal_filter(spark, sf_dir):
    rows = url_path(spark, sf_dir)
    return rows.where(~paths.is_internal(F.col("path"), INTERNAL))


@_query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), r AS (SELECT unnest(['/en', '/de', '/fr', '/fr/1', '']) AS root)
  SELECT page_id, max_by(root, length(root)) AS owner FROM p JOIN r ON starts_with(path, root || '/') OR root = '' GROUP BY page_id""")
def prefix_owner(spark, sf_dir):
    # prefixes of a path are its own parts: an equi join with the table of roots instead of a nested loop
    parts = url_path(spark, sf_dir).withColumn("parts", F.split("path", "/"))
    own = parts.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))).alias("root"))
    roots = spark.createDataFrame([(r,) for r in ("/en", "/de", "/fr", "/fr/1", "")], "root string")
    best = own.join(F.broadcast(roots), "root").groupBy("page_id").agg(F.max_by("root", F.length("root")).alias("owner"))
    return parts.select("page_id").join(best, "page_id", "left").select("page_id", F.coalesce("owner", F.lit("")).alias("owner"))


_REDACTED = "text"
for _p in text.KEYS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '{text.MASK}', 'g')"
_PAIRS_SQL = text.PAIRS.replace("'", "''")
_REDACTED = f"regexp_replace({_REDACTED}, '{_PAIRS_SQL}', '\\1\\2{text.MASK}', 'g')"


@_query(f"SELECT doc_id, {_REDACTED} AS text FROM documents")
def redact(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@_query("SELECT doc_id, trim(string_split(trim(text), chr(10))[1]) AS hint FROM documents")
def doc_hint(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("hint"))


_PHRASES = [("click", "Clicked"), ("view", "Viewed"), ("purchase", "Bought")]


@_query("""WITH d AS (SELECT * FROM (VALUES ('click', 'Clicked'), ('view', 'Viewed'), ('purchase', 'Bought')) t(event_type, phrase))
  SELECT event_id, coalesce(phrase, 'Response') AS phrase FROM events LEFT JOIN d USING (event_type)""")
def status_phrase(spark, sf_dir):
    phrases = spark.createDataFrame(_PHRASES, "event_type string, phrase string")
    return _read(spark, sf_dir, "events").join(F.broadcast(phrases), "event_type", "left").select("event_id", F.coalesce("phrase", F.lit("Response")).alias("phrase"))


@_query("""SELECT event_type, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(CAST(count(*) FILTER (value > 50) AS DOUBLE) / count(*), 4) END AS complete FROM events GROUP BY ALL""")
def completeness(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(text.safe_ratio(F.count_if(F.col("value") > 50), F.count("*")).alias("complete"))


@_query("""WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS h, count(*) FILTER (o_orderstatus = 'O') AS m, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS l,
    count(*) FILTER (o_totalprice > 100000) AS ok, count(*) AS n, count(*) FILTER (o_orderpriority LIKE '1%') AS errors, count(*) FILTER (o_orderpriority LIKE '5%') AS failures FROM orders GROUP BY 1),
  t AS (SELECT *, 0.30 * ok / n + 0.20 * CASE WHEN errors = 0 THEN 1 ELSE 0 END + 0.20 * (h + 0.5 * m) / greatest(h + m + l, 1) + 0.30 AS raw FROM s)
  SELECT o_custkey, CAST(floor(10000 * raw * CASE WHEN failures > 0 THEN greatest(0.85, 1 - 0.02 * failures) ELSE 1 END + 0.3137) AS BIGINT) AS score FROM t""")
def readiness(spark, sf_dir):
    n = lambda c: F.count_if(c)
    status = F.col("o_orderstatus")
    rows = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        n(status == "F").alias("high"), n(status == "O").alias("medium"), n(~status.isin("F", "O")).alias("low"), n(F.col("o_totalprice") > 100000).alias("gates_passed"), F.count("*").alias("gates"),
        n(F.col("o_orderpriority").startswith("1")).alias("errors"), n(F.col("o_orderpriority").startswith("5")).alias("failures"))
    for c in report.LEAST:
        rows = rows.withColumn(c, F.lit(1.0))
    return rows.select("o_custkey", F.floor(10000 * report.score(rows) + 0.3137).cast("long").alias("score"))


@_query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'negative balance' END, CASE WHEN n_name LIKE 'A%' THEN 'listed nation' END,
    CASE WHEN n_regionkey IS NULL THEN 'no region' END], lambda x: x IS NOT NULL), '; ') AS issues FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def blocking_issues(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    rows = _read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == nation["n_nationkey"], "left")
    issues = F.array(F.when(F.col("s_acctbal") < 0, "negative balance"), F.when(F.col("n_name").startswith("A"), "listed nation"), F.when(F.col("n_regionkey").isNull(), "no region"))
    return rows.select("s_suppkey", F.array_join(F.filter(issues, lambda x: x.isNotNull()), "; ").alias("issues"))


@_query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
  SELECT user_id, event_type AS top_ref, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS k FROM c) WHERE k = 1""")
def top_error_ref(spark, sf_dir):
    c = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("top_ref"), F.col("m.n").alias("n"))


@_query("""SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS variants, count(DISTINCT l_returnflag) > 1 AS any_of FROM lineitem GROUP BY 1""")
def merge_variants(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("variants"), (F.min("l_returnflag") != F.max("l_returnflag")).alias("any_of"))


@_query("""SELECT conv_id, arg_min(text, turn) AS hint FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def first_hint(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.min_by("text", "turn").alias("hint"))


@_query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def keep_first(spark, sf_dir):
    return relational.keep_first(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@_query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def edge_dedupe(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@_query("SELECT conv_id, role, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INTEGER) AS variant_index FROM conversations")
def variant_index(spark, sf_dir):
    return relational.variant_index(_read(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "variant_index")


@_query("""WITH r AS (SELECT user_id, value < 50 AS failed, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
  e AS (SELECT user_id, run, count(*) AS n FROM r WHERE failed GROUP BY ALL)
  SELECT user_id, CAST(max(n) AS BIGINT) AS longest, max(n) >= 5 AS broken FROM e GROUP BY 1""")
def failure_streak(spark, sf_dir):
    out = relational.failure_streaks(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") < 50)
    return out.withColumn("broken", F.col("longest") >= 5)


@_query("""SELECT source, CASE max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence
  FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def worst_level(spark, sf_dir):
    rank = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source").join(_read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.max(rank) + 1).alias("confidence"))


@_query("""WITH h AS (SELECT doc_id, lang, sha256(text) AS hash FROM documents),
  d AS (SELECT lang, hash, min(doc_id) AS first_doc, count(*) AS n FROM h GROUP BY ALL)
  SELECT lang, hash, first_doc, CAST(n AS BIGINT) AS n, CAST(dense_rank() OVER (PARTITION BY lang ORDER BY hash) AS INTEGER) AS shape FROM d""")
def intern_schemas(spark, sf_dir):
    from pyspark.sql import Window

    d = _read(spark, sf_dir, "documents").groupBy("lang", F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return d.withColumn("shape", F.dense_rank().over(Window.partitionBy("lang").orderBy("hash")))


@_query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def structural_hash(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


@_query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type)))[1:20], ',') AS top FROM part GROUP BY 1")
def top_fields(spark, sf_dir):
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 20), ",").alias("top"))


@_query("SELECT p_brand, array_to_string(list(CAST(p_partkey AS VARCHAR) ORDER BY p_size, p_name, p_partkey), ',') AS ordered FROM part GROUP BY 1")
def canonical_order(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("p_size", "p_name", "p_partkey")))
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(ordered.alias("o")).select("p_brand", F.array_join(F.transform("o", lambda x: x["p_partkey"].cast("string")), ",").alias("ordered"))


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def gate_omitted(spark, sf_dir):
    return relational.missing(_read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_acctbal > 0)")
def gate_invented(spark, sf_dir):
    return relational.missing(_read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@_query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def gate_duplicates(spark, sf_dir):
    return relational.duplicates(_read(spark, sf_dir, "events"), ["user_id", "event_type"])


@_query("""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: NOT list_contains(string_split(lower(p_type), ' '), x))), ',') AS undeclared FROM part""")
def gate_params(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(F.split("p_name", " "), F.split(F.lower("p_type"), " "))), ",").alias("undeclared"))


@_query("""WITH s AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders), k AS (SELECT DISTINCT o_custkey FROM orders),
  w AS (SELECT o_custkey, st AS o_orderstatus FROM k, (SELECT unnest(['F', 'O', 'P']) AS st))
  SELECT o_custkey, o_orderstatus, 'declared' AS origin FROM s UNION ALL
  SELECT o_custkey, o_orderstatus, 'conventional' FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = w.o_custkey AND s.o_orderstatus = w.o_orderstatus)""")
def conventional(spark, sf_dir):
    own = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    added = own.select("o_custkey", F.explode(F.array_except(F.array(F.lit("F"), F.lit("O"), F.lit("P")), "s")).alias("o_orderstatus"), F.lit("conventional").alias("origin"))
    return own.select("o_custkey", F.explode("s").alias("o_orderstatus"), F.lit("declared").alias("origin")).unionByName(added)


@_query("""SELECT k AS nationkey, coalesce(a, b) AS value FROM (SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) n
  LEFT JOIN (SELECT c_nationkey, max(CASE WHEN c_acctbal > 9000 THEN c_name END) AS a FROM customer GROUP BY 1) c ON k = c_nationkey
  LEFT JOIN (SELECT s_nationkey, min(s_name) AS b FROM supplier GROUP BY 1) s ON k = s_nationkey""")
def layered_config(spark, sf_dir):
    high = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.max(F.when(F.col("c_acctbal") > 9000, F.col("c_name"))).alias("value"))
    low = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.min("s_name").alias("value"))
    return relational.layered([high, low], "nationkey", "value")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> ''))"


@_query(f"""WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS x FROM benchmark), t AS (SELECT DISTINCT unnest({_WORDS}) AS t FROM documents)
  SELECT DISTINCT t FROM t JOIN w ON t = x OR t = rtrim(x, 's') OR t = x || 's'""")
def plural_match(spark, sf_dir):
    w = _words(spark, sf_dir, "benchmark", "x")
    forms = w.select(F.explode(F.array_distinct(F.array(F.col("x"), F.rtrim("x", F.lit("s")), F.concat("x", F.lit("s"))))).alias("t")).distinct()
    return _words(spark, sf_dir, "documents", "t").join(forms, "t", "left_semi")


def _words(spark, sf_dir, name, to):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    return _read(spark, sf_dir, name).select(F.explode(words).alias(to)).distinct()


@_query("""SELECT c_custkey, '/' || r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def include_graph(spark, sf_dir):
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    tree = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("prefix"))
    return _read(spark, sf_dir, "customer").join(tree, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", "prefix", "c_name").alias("path"))


@_query("""WITH RECURSIVE c(conv_id, turn, depth) AS (SELECT conv_id, min(turn), 0 FROM conversations GROUP BY 1 UNION ALL
    SELECT c.conv_id, c.turn + 1, depth + 1 FROM c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1 WHERE depth < 4)
  SELECT DISTINCT conv_id, turn, CAST(depth AS INTEGER) AS depth FROM c""")
def call_depth(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    start = rows.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    node = F.struct("conv_id", "turn")
    edges = rows.select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("a"), node.alias("b"))
    found = graph.reachable(edges, start.select(node.alias("node")), 4)
    return found.select("node.conv_id", "node.turn", "depth")


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 500 AS a, l_suppkey % 500 AS b FROM lineitem WHERE l_partkey % 500 > l_suppkey % 500 AND l_quantity > 45),
  r(node) AS (SELECT 499 UNION SELECT b FROM r JOIN e ON a = node) SELECT CAST(node AS BIGINT) AS node FROM r""")
def reachable(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").where("l_quantity > 45").selectExpr("l_partkey % 500 AS a", "l_suppkey % 500 AS b").where("a > b").distinct()
    return graph.reachable(lines, spark.range(499, 500).withColumnRenamed("id", "node")).select("node")


@_query("""SELECT r_name, to_json(list({id: n_nationkey, spec: n_name || '.json'} ORDER BY n_nationkey)) AS catalog FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def catalog(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    specs = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(".json")).alias("spec"))))
    return rows.groupBy("r_name").agg(F.to_json(specs).alias("catalog"))


@_query("")
def canonical_json(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.to_json(F.parse_json("props")).alias("props"))


@_query(f"SELECT DISTINCT word FROM (SELECT unnest({_WORDS}) AS word FROM documents UNION ALL SELECT unnest({_WORDS}) FROM benchmark)")
def vocab(spark, sf_dir):
    return _words(spark, sf_dir, "documents", "word").union(_words(spark, sf_dir, "benchmark", "word")).distinct()
