from corvina.plans import report

COLUMNS = "service string, high int, medium int, low int, gates_passed int, gates int, errors int, response_completeness double, request_completeness double, parameter_completeness double, failures int, unresolved int"
GOLDEN = [("budget", 29, 7, 0, 98.1), ("category", 16, 10, 0, 96.2), ("expense", 57, 26, 0, 96.9), ("income", 33, 16, 0, 96.7), ("notification", 11, 2, 0, 98.5), ("reporting", 19, 5, 1, 97.2), ("savings-goal", 28, 18, 0, 96.1), ("user", 31, 20, 0, 96.1)]


def test_published_scores(spark):
    rows = spark.createDataFrame([(s, h, m, l, 6, 6, 0, 1.0, 1.0, 1.0, 0, 0) for s, h, m, l, _ in GOLDEN], COLUMNS)
    got = report.scored(rows)
    assert {r["service"]: r["readiness"] for r in got.collect()} == {g[0]: g[4] for g in GOLDEN}
    assert tuple(report.overall(got).first()) == (97.0, True, 8, True)


def test_penalties_and_issues(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 0, 0, 1, 0.5, 1.0, 1.0, 20, 2)], COLUMNS)
    r = report.scored(rows).first()
    assert r["readiness"] == round(100 * (0.3 + 0.15 * 0.5 + 0.15) * 0.85, 1)
    assert r["issues"] == ["2 unresolved", "response completeness below 0.75", "validation errors"] and not r["production_ready"]


def test_coverage(spark):
    schema = "repo_id string, service string, path string, method string, parameters array<struct<location:string,type:string>>, statuses array<string>, duplicate boolean, request string, response string"
    rows = [
        ("r", "a", "/x", "get", [("query", "string")], ["200"], False, None, "{\"type\":\"string\"}"), ("r", "a", "/x", "post", [("body", "object")], ["201"], False, "{}", "{}"),
        ("r", "a", "/x/{i}", "delete", [], ["204"], False, None, None), ("r", "a", "/x", "get", [], ["200"], True, None, None), ("r", "a", "/health", "get", [], ["200"], False, None, None),
    ]
    gates = spark.createDataFrame([("r", "a", "g", True), ("r", "a", "h", False)], "repo_id string, service string, gate string, passed boolean")
    (row,) = report.scored(report.coverage(spark.createDataFrame(rows, schema), gates, ["/health"])).collect()
    assert (row["operations"], row["endpoints"], row["gates"], row["gates_passed"]) == (3, 2, 2, 1)
    assert (row["response_completeness"], row["request_completeness"], row["parameter_completeness"]) == (0.6667, 0.0, 1.0)
    assert (row["high"], row["medium"], row["low"]) == (4, 1, 1) and not row["production_ready"] and "failed gates" in row["issues"]
