import itertools
import json

from corvina.operators import schemas
from corvina.plans import sinks

REF = lambda n: {"$ref": schemas.REF + n}


def test_cycles():
    graph = {"a": {"b"}, "b": {"c"}, "c": {"b", "d"}, "d": set(), "e": {"e"}}
    assert sorted(schemas.cycles(graph)) == [["a"], ["b", "c"], ["d"], ["e"]]
    found = schemas.cycles(graph)
    assert found.index(["d"]) < found.index(["b", "c"]) < found.index(["a"])


def test_hashes():
    one = {"User": {"title": "x", "properties": {"team": REF("Team")}}, "Team": {"properties": {"users": {"type": "array", "items": REF("User")}}}}
    orders = [schemas.structural_hashes(dict(p)) for p in itertools.permutations(one.items())]
    assert orders[0] == orders[1] and orders[0]["User"] != orders[0]["Team"]
    same = schemas.structural_hashes({"A": {"type": "string", "description": "x"}, "B": {"type": "string"}, "C": {"items": REF("A")}, "D": {"items": REF("B")}, "E": REF("gone")})
    assert same["A"] == same["B"] != same["C"] == same["D"] and len(same["E"]) == 16


def test_merged(spark):
    rows = [("r", "p.X", "X", "s1", '{"type":"string"}'), ("r", "q.X", "X", "s2", '{"type":"integer"}'), ("r", "s.X", "X", "s2", '{"type":"string"}'), ("r", "t", "T", "s1", json.dumps(REF("lost")))]
    df = spark.createDataFrame(rows, "repo_id string, schema_id string, title string, service string, schema string")
    got = {r["name"]: r["used_by"] for r in schemas.merged(schemas.hashed(df)).collect()}
    other = next(k for k in got if k.startswith("X_"))
    assert got == {"X": ["s1", "s2"], other: ["s2"], "T": ["s1"]}
    assert [tuple(r) for r in schemas.dangling(df).collect()] == [("r", "t", "lost")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("r", "a/b:x", '{"b":1,"a":null}'), ("r", "c", "{}"), ("q", "c", '{"é":[1.0]}')], "repo_id string, service string, document string")
    assert sinks.write_documents(docs, str(tmp_path)) == 3
    # documents keep the order of their keys, and nulls
    assert (tmp_path / "q/openapi.json").read_text() == '{\n  "é": [\n    1.0\n  ]\n}\n' and (tmp_path / "r/openapi.a_b_x.json").read_text() == '{\n  "b": 1,\n  "a": null\n}\n'
    assert json.loads((tmp_path / "r/catalog.json").read_text()) == [{"id": "a/b:x", "spec": "openapi.a_b_x.json"}, {"id": "c", "spec": "openapi.c.json"}]
    assert sinks.canonical_json({"b": 1, "a": None, "é": [1.0]}) == '{"b":1,"é":[1.0]}\n'
    assert {r["repo_id"]: json.loads(r["catalog"]) for r in sinks.catalog(sinks.service_paths(docs, "o.json")).collect()} == {"r": [{"id": "a/b:x", "spec": "o.a_b_x.json"}, {"id": "c", "spec": "o.c.json"}]}
