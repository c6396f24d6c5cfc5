from pyspark.sql import functions as F

from corvina.plans import adapters, enrichment
from corvina.sources import tree

FILES = [
    ("py", "requirements.txt", "fastapi>=1\n"), ("py", "a/main.py", "import fastapi\nfrom os import x\n"),
    ("jv", "pom.xml", "<project><artifactId>a</artifactId><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-web</artifactId></dependency></dependencies></project>"),
    ("jv", "A.java", "import org.springframework.web.bind.annotation.GetMapping;\nimport java.util.List;\n@RestController class A {}"),
    ("dj", "settings.py", "from django.conf import x\nimport rest_framework\n"), ("dj", "requirements.txt", "Django\ndjangorestframework\n"),
    ("rs", "B.java", "import jakarta.ws.rs.GET;\n@Path(\"/b\") class B { RouterFunction<X> x; }"), ("none", "x.txt", "x"),
]
OPERATION = "repo_id string, service string, path string, method string, tags array<string>, statuses array<string>, parameters array<struct<name:string>>, duplicate boolean"
TEXT = "repo_id string, service string, path string, method string, summary string, description string, tags array<string>, responses map<string,string>, parameters map<string,string>"


def test_scores_and_languages(spark):
    files = spark.createDataFrame([(r, p, len(t), bytearray(t.encode())) for r, p, t in FILES], tree.FILES)
    found = adapters.signals(files, tree.manifests(files)).cache()
    got = {(r["repo_id"], r["adapter"], r["score"], r["rank"]) for r in adapters.active(adapters.scores(found)).collect()}
    assert got == {("py", "fastapi", 0.95, 1), ("jv", "spring-mvc", 0.9, 1), ("dj", "django", 0.95, 1), ("rs", "jaxrs", 0.8, 1)}
    assert {(r["repo_id"], tuple(r["languages"]), r["ambiguous"]) for r in adapters.languages(found).collect()} == {("py", ("python",), False), ("jv", ("java",), False), ("dj", ("python",), False), ("rs", ("java",), False), ("none", (), True)}


def test_texts(spark):
    row = spark.range(1).select(enrichment.words(F.lit("getHTTPThing_by-id2")).alias("w"), enrichment.summary(F.lit("get"), F.lit("/api/big-items"), F.lit("get")).alias("a"), enrichment.summary(F.lit("delete"), F.lit("/items/{id}"), F.lit("drop_item")).alias("b"), enrichment.summary(F.lit("get"), F.lit("/"), F.lit(None).cast("string")).alias("c")).first()
    assert row["w"] == ["get", "http", "thing", "by", "id2"] and (row["a"], row["b"], row["c"]) == ("List big items", "Drop item", "Get resource")


def test_grounded(spark):
    key = ("r", "s", "/api/pets/{id}", "get")
    ops = spark.createDataFrame([(*key, ["pets"], ["200", "404"], [("id",)], False)], OPERATION)
    assert [r["overview"] for r in enrichment.overviews(ops).collect()] == ["API for the s. Provides operations over: pets."]
    cases = [("One pet", None, ["pet"], {"404": "gone"}, {"id": "its id"}, None), ("x", None, [], {"500": "y"}, {}, "status not declared"), ("x", None, [], {}, {"q": "y"}, "parameter not declared"), ("gives 409", None, [], {}, {}, "number of a status that is not declared"), ("see /api/pets/{id}.", None, [], {}, {}, None), ("see /other/x", None, [], {}, {}, "path of another operation"), ("requires bearer", None, [], {}, {}, "authentication without security"), ("x", None, ["cars"], {}, {}, "tag outside the vocabulary"), ("x", None, None, None, None, None)]
    texts = spark.createDataFrame([(*key, f"{c[0]}", str(n), *c[2:5]) for n, c in enumerate(cases)], TEXT)
    nobody = ops.where("false")
    assert {int(r["description"]): r["reason"] for r in enrichment.grounded(texts, ops, nobody).collect()} == {n: c[5] for n, c in enumerate(cases)}
    assert {int(r["description"]): r["reason"] for r in enrichment.grounded(texts, ops, ops).collect()}[6] is None


def test_cache(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "payload string").withColumn("cache_key", enrichment.cache_key(F.lit("p"), F.lit("m"), F.lit("1"), F.col("payload")))
    hits, misses = enrichment.looked_up(asked, asked.where("payload = 'a'").select("cache_key", F.lit("yes").alias("answer")))
    assert [(r["payload"], r["answer"]) for r in hits.collect()] == [("a", "yes")] and [r["payload"] for r in misses.collect()] == ["b"]


def test_modules_and_versions(spark):
    rows = [
        ("m", "pom.xml", "<project xmlns=\"http://x\"><modules><module>a</module><module> b </module></modules></project>"),
        ("g", "settings.gradle.kts", "rootProject.name = \"x\"\ninclude(\":api\", \":core:io\")\ninclude 'web',\n  'tools'\n"),
        ("c", "compose.yaml", "services:\n  a:\n    build: ./one\n  b:\n    build:\n      context: 'two'\n  c:\n    image: x\n"),
        ("v", "a/requirements.txt", "flask\n"), ("v", "b/requirements.txt", "flask==2\nx>=1\n"), ("e", "pom.xml", ""), ("e", "a/pom.xml", "<project><artifactId>x</artifactId><dependencies><dependency>"),
        ("t", "pom.xml", "<project><artifactId>t</artifactId><parent><groupId>g</groupId><artifactId>up</artifactId><version>3</version></parent><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency><dependency><groupId>g</groupId><artifactId>a</artifactId><version>2</version></dependency></dependencies></project>"),
    ]
    files = spark.createDataFrame([(r, p, len(t), bytearray(t.encode())) for r, p, t in rows], tree.FILES)
    assert {(r["repo_id"], r["module"]) for r in tree.declared_modules(files).collect()} == {("m", "a"), ("m", "b"), ("g", "api"), ("g", "core/io"), ("g", "web"), ("g", "tools"), ("c", "one"), ("c", "two")}
    assert {(r["name"], r["version"]) for r in tree.dependency_versions(tree.manifests(files.where("repo_id = 'v'"))).collect()} == {("flask", None), ("x", ">=1")}
    found = {(r["repo_id"], r["path"]): r for r in tree.manifests(files).collect()}
    assert found["t", "pom.xml"]["deps"] == {"g:a": "2", "parent:g:up": "3"} and found["t", "pom.xml"]["name"] == "t" and not found["e", "pom.xml"]["deps"]
