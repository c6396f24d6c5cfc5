from pyspark.sql import functions as F

from corvina.functions import paths, text
from corvina.operators import graph, relational


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_paths(spark):
    assert _one(spark, paths.url_path(F.col("u")), u="http://a.b/c/d/?q=1#x") == "/c/d"
    assert _one(spark, paths.url_path(F.col("u")), u="/c/") == "/c"
    assert _one(spark, paths.join_path(F.col("a"), F.col("b")), a="/api/", b="//x/") == "/api/x"
    assert _one(spark, paths.template(F.col("u")), u="/pets/12/x") == "/pets/{id}/x"
    assert _one(spark, paths.typed_template(F.col("u")), u="/a/{p:path}/<int:n>/<m>/") == "/a/{p}/{n}/{m}"
    assert _one(spark, paths.pascal(F.col("u")), u="pet_store-v2") == "PetStoreV2"
    assert _one(spark, paths.operation_base(F.col("m"), F.col("u")), m="GET", u="/api/v1/pets/{pet_id}") == "getPetsByPetId"
    assert _one(spark, paths.operation_base(F.col("m"), F.col("u")), m="POST", u="/") == "post"
    assert _one(spark, paths.is_internal(F.col("u"), ["/internal"]), u="/internal/x") is True
    assert _one(spark, paths.is_internal(F.col("u"), ["/internal"]), u="/internals") is False


def test_redact(spark):
    got = _one(spark, text.redact(F.col("t"), ["hunter22"]), t="hunter22 api_key = 'abcdefgh1' sk-" + "a" * 20)
    assert got == f"{text.MASK} api_key = '{text.MASK}' {text.MASK}"


def test_safe_ratio(spark):
    assert _one(spark, text.safe_ratio(F.lit(1), F.lit(0)), t="") == 1.0
    assert _one(spark, text.safe_ratio(F.lit(1), F.lit(3)), t="") == 0.3333


def test_layers_and_names(spark):
    a, b = spark.createDataFrame([("k", None), ("m", "1")], "k string, v string"), spark.createDataFrame([("k", "2"), ("m", "3"), ("n", None)], "k string, v string")
    assert {tuple(r) for r in relational.layered([a, b], "k", "v").collect()} == {("k", "2"), ("m", "1"), ("n", None)}
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "b string, o int")
    assert [r["id"] for r in relational.unique_names(rows, "b", ["o"], "id").orderBy("o").collect()] == ["x", "x_2", "y"]


def test_reachable_ends_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.reachable(edges, start, 9).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
