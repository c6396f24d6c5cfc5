"""Which framework readers a repository calls for: signals of sources and manifests, scores, and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tree

# Tracked packages, import prefixes (the first that fits counts), annotations, and scores.
PYTHON_PACKAGES = ["fastapi", "flask", "django", "rest_framework", "starlette", "aiohttp", "litestar", "pydantic"]
JAVA_PREFIXES = ["org.springframework.web.reactive", "org.springframework.web", "org.springframework.security", "org.springframework", "javax.ws.rs", "jakarta.ws.rs", "javax.validation", "jakarta.validation", "com.fasterxml.jackson", "io.micronaut", "io.quarkus"]
ANNOTATIONS = ["RestController", "Controller", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "Path", "GET", "POST", "PUT", "DELETE", "ApplicationPath", "ControllerAdvice", "RestControllerAdvice", "EnableWebFlux", "SpringBootApplication", "PreAuthorize", "RolesAllowed"]
THRESHOLD, MOST = 0.5, 0.95
WEB = ["org.springframework.boot:spring-boot-starter-web", "org.springframework:spring-webmvc"]
REACTIVE = ["org.springframework.boot:spring-boot-starter-webflux", "org.springframework:spring-webflux"]
REST = ["org.jboss.resteasy:", "org.glassfish.jersey", "io.quarkus:quarkus-rest", "org.apache.cxf:"]


def java_signals(files: DataFrame) -> DataFrame:
    """(repo_id, kind, name): tracked import prefixes and annotations of Java files, and RouterFunction."""
    text = tree.text(F.col("content"))
    java = files.where(F.col("path").endswith(".java"))
    imports = F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;"), F.lit(1))
    prefix = lambda x: F.coalesce(*[F.when(x.startswith(p), F.lit(p)) for p in JAVA_PREFIXES])
    marks = F.regexp_extract_all(text, F.lit(rf"@({'|'.join(ANNOTATIONS)})\b"), F.lit(1))
    routers = F.when(text.rlike(r"\bRouterFunction\s*<"), F.array(F.lit("RouterFunction"))).otherwise(F.array().cast("array<string>"))
    named = lambda kind, names: F.transform(F.array_distinct(names), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    pairs = F.concat(named("import", F.transform(imports, prefix)), named("annotation", F.concat(marks, routers)))
    return java.select("repo_id", F.explode(pairs).alias("p")).select("repo_id", "p.*").where("name IS NOT NULL").distinct()


def signals(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row a repository: counts of sources, and sorted arrays of dependencies, imports and annotations."""
    key = "repo_id"
    counts = files.groupBy(key).agg(F.count_if(F.col("path").endswith(".py")).alias("n_python"), F.count_if(F.col("path").endswith(".java")).alias("n_java"), F.coalesce(F.bool_or(F.col("path").rlike(r"(^|/)(settings|urls)\.py$")), F.lit(False)).alias("has_settings"))
    deps = tree.dependency_names(manifests).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("dependencies"))
    found = tree.import_signals(files, PYTHON_PACKAGES).select(key, F.lit("import").alias("kind"), F.col("package").alias("name")).unionByName(java_signals(files))
    found = found.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(to) for k, to in (("import", "imports"), ("annotation", "annotations"))])
    out = counts.join(deps, key, "left").join(found, key, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("dependencies", "imports", "annotations")})


def _any(column: str, names: list[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, names)))


def _points(*parts: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, points in parts:
        out = out + F.when(condition, points).otherwise(0.0)
    return out


def scores(signals: DataFrame) -> DataFrame:
    """(repo_id, adapter, score) of each reader, from 0 to 0.95."""
    dep, imp, mark = (lambda *n: _any("dependencies", list(n))), (lambda *n: _any("imports", list(n))), (lambda *n: _any("annotations", list(n)))
    web, reactive = dep(*WEB), dep(*REACTIVE)
    web_only = imp("org.springframework.web") & ~imp("org.springframework.web.reactive")
    mvc = _points((web, 0.55), (mark("RestController", "Controller"), 0.35), (~web & web_only, 0.40))
    rest = F.exists("dependencies", lambda d: F.coalesce(*[F.when(d.startswith(p), True) for p in REST], F.lit(False)))
    points = {
        "fastapi": _points((dep("fastapi"), 0.60), (imp("fastapi"), 0.35)),
        "flask": _points((dep("flask"), 0.60), (dep("fastapi"), -0.20), (imp("flask"), 0.35)),
        "django": _points((dep("django"), 0.50), (dep("djangorestframework"), 0.20), (imp("django", "rest_framework"), 0.25), (F.col("has_settings"), 0.10)),
        "spring-mvc": F.when(reactive & ~web, F.least(mvc, F.lit(0.30))).otherwise(mvc),
        "spring-webflux": F.when(web & ~reactive, 0.0).otherwise(_points((reactive, 0.60), (imp("org.springframework.web.reactive"), 0.30), (mark("RouterFunction"), 0.10))),
        "jaxrs": _points((imp("javax.ws.rs", "jakarta.ws.rs"), 0.70), (rest, 0.20), (mark("Path"), 0.10)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("adapter"), F.round(F.greatest(F.lit(0.0), F.least(v, F.lit(MOST))), 4).alias("score")) for k, v in points.items()])
    return signals.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")


def active(scores: DataFrame) -> DataFrame:
    """Readers that score enough, with their order in the repository."""
    order = Window.partitionBy("repo_id").orderBy(F.desc("score"), "adapter")
    return scores.where(F.col("score") >= THRESHOLD).withColumn("rank", F.row_number().over(order))


def languages(signals: DataFrame, forced: str | None = None) -> DataFrame:
    """(repo_id, languages, ambiguous): strongest first, Python before Java at equal points; none found is ambiguous."""
    if forced:
        return signals.select("repo_id", F.array(F.lit(forced)).alias("languages"), F.lit(False).alias("ambiguous"))
    python = F.least("n_python", F.lit(50)) + _points((_any("dependencies", ["fastapi", "flask", "django", "djangorestframework"]), 40), (_any("imports", ["fastapi", "flask", "django", "rest_framework"]), 20))
    java_dep = F.exists("dependencies", lambda d: d.startswith("org.springframework") | d.startswith("javax.ws.rs") | d.startswith("jakarta.ws.rs"))
    java = F.least("n_java", F.lit(50)) + _points((java_dep, 40), (F.size("annotations") > 0, 20))
    both = F.array(F.struct((-python).alias("p"), F.lit(0).alias("k"), F.lit("python").alias("l")), F.struct((-java).alias("p"), F.lit(1).alias("k"), F.lit("java").alias("l")))
    found = F.transform(F.filter(F.array_sort(both), lambda x: x["p"] < 0), lambda x: x["l"])
    return signals.select("repo_id", found.alias("languages")).withColumn("ambiguous", F.size("languages") == 0)
