from corvina.functions.java_facts import facts, functional, routes
from corvina.plans import java_services, services
from corvina.sources import tree

BOOKS = '''package a; // @GetMapping("/no")
/* @RestController class No {} */
@RestController
@RequestMapping("/api/v1/books")
public class BookController {
    private final Map<String, List<Book>> m = new HashMap<>();
    @GetMapping
    public List<Book> list(@RequestParam(defaultValue = "0") int page, @RequestParam(name = "q", required = false) String query) { if (x) { call(); } return null; }
    @PostMapping
    @ResponseStatus(HttpStatus.CREATED)
    public Book create(@Valid @RequestBody CreateBook body) { return null; }
    @RequestMapping(value = {"/{id}", "/by/{id}"}, method = {RequestMethod.PUT, RequestMethod.DELETE})
    Book change(@PathVariable("id") long id, @RequestHeader("X-A") String a) { return null; }
    static class Inner { @GetMapping("/no") void no() {} }
}
'''
ITEMS = '@Path("/items") public class Items {\n @GET @Path("/{id: [0-9]+}") public Item one(@PathParam("id") long id, @QueryParam("v") @DefaultValue("1") int v) { return null; }\n @DELETE public void clear() {}\n}\n@Broken(\n'


def test_routes():
    got = [(r["method"], r["route"]) for kind, _, r in routes(BOOKS) if kind == "route"]
    assert got == [("get", ""), ("post", ""), ("put", "/{id}"), ("put", "/by/{id}"), ("delete", "/{id}"), ("delete", "/by/{id}")]
    assert routes("") == [] and routes("@") is not None and len(routes(ITEMS)) == 3


def test_operations(spark):
    rows = [("m", "orders/src/B.java", BOOKS), ("m", "users/src/I.java", ITEMS), ("m", "pom.xml", "<project xmlns='p'><artifactId>all</artifactId></project>"), ("m", "users/pom.xml", "<project><artifactId>users-service</artifactId></project>"), ("alone", "I.java", ITEMS)]
    files = spark.createDataFrame([(r, p, len(t), bytearray(t.encode())) for r, p, t in rows], tree.FILES)
    ops = java_services.operations(facts(files), tree.manifests(files)).cache()
    got = {(r["service"], r["path"], r["method"]) for r in ops.collect()}
    books = {("all", p, m) for p, m in [("/api/v1/books", "get"), ("/api/v1/books", "post"), *[(f"/api/v1/books{x}/{{id}}", m) for x in ("", "/by") for m in ("put", "delete")]]}
    assert got == books | {(s, p, m) for s in ("users-service", "alone") for p, m in [("/items/{id}", "get"), ("/items", "delete")]}
    by = {(r["path"], r["method"]): r for r in ops.collect()}
    assert [(p["name"], p["location"], p["required"], p["type"]) for p in by["/api/v1/books", "get"]["parameters"]] == [("page", "query", False, "integer"), ("q", "query", False, "string")]
    assert by["/api/v1/books", "post"]["statuses"] == ["201"] and by["/api/v1/books", "post"]["parameters"][0]["ref"] == "CreateBook"
    assert [(p["name"], p["location"]) for p in by["/api/v1/books/{id}", "put"]["parameters"]] == [("id", "path"), ("X-A", "header")]
    assert all(r["passed"] for r in services.gates(ops, services.documents(ops)).collect())


LISTS = '''class Routes {
    @Bean RouterFunction<ServerResponse> old(Handler h) { return route(GET("/lists"), h::all).andRoute(POST("/lists"), h::add); }
    @Bean RouterFunction<ServerResponse> built(Handler h) { return route().path("/v2", b -> b.GET("/lists/{name}", accept(JSON), h::one).DELETE("/lists/{name}", h::drop)).HEAD("/up", r -> ok()).build(); }
    @Bean RouterFunction<ServerResponse> nested(Handler h) { return nest(path("/in"), route(PUT("/x"), h::put)); }
    // GET("/no")
}'''


def test_functional():
    got = [(v["method"], v["prefix"] + v["route"], v["function"], [p["name"] for p in v["parameters"]]) for _, _, v in functional(LISTS)]
    assert got == [("get", "/lists", "all", []), ("post", "/lists", "add", []), ("get", "/v2/lists/{name}", "one", ["name"]), ("delete", "/v2/lists/{name}", "drop", ["name"]), ("head", "/up", "head", []), ("put", "/in/x", "put", [])]
    assert functional("") == [] and functional(BOOKS) == [] and functional("RouterFunction GET(") == []


def test_functional_operations(spark):
    files = spark.createDataFrame([("w", "R.java", len(LISTS), bytearray(LISTS.encode()))], tree.FILES)
    ops = java_services.operations(facts(files), tree.manifests(files)).cache()
    assert ops.count() == 6 and {r["framework"] for r in ops.collect()} == {"spring-webflux"}
    assert all(r["passed"] for r in services.gates(ops, services.documents(ops)).collect())


def test_bodies_look_up_their_own_names_only(spark, monkeypatch):
    """A row for a handler carries what its own type texts mean, not the names of all handlers of its controller."""
    from pyspark.sql import functions as F

    from corvina.functions import java_types
    from corvina.plans import java_contracts

    each = "".join(f'  @PostMapping("/{k}") Box<S{k}> add{k}(@RequestBody In{k} in) {{ return null; }}\n  static class S{k} {{ int n; }}\n  static class In{k} {{ int n; }}\n' for k in range(30))
    text = "package a; @RestController class Api {\n  static class Box<T> { T one; }\n" + each + '  @GetMapping("/none") void none() {}\n}\n'
    files = spark.createDataFrame([("r", "Api.java", len(text), bytearray(text.encode()))], tree.FILES)
    types = java_contracts.index(java_types.types(files))
    known = java_contracts.known_names(types)
    handled = java_contracts.cut(java_contracts.methods_of(java_services.operations(facts(files), tree.manifests(files)), types))
    got = {r["path"]: r for r in java_contracts.bodies(handled, known).collect()}
    assert len(got) == 31 and got["/none"]["response"] is None
    assert all([x["qualified"] for x in got[f"/{k}"]["references"]] == [f"a.Api.In{k}", "a.Api.Box"] for k in range(30))
    shape = "struct<schema:string,level:string,reason:string,references:array<struct<schema_id:string,qualified:string,arguments:string>>>"
    monkeypatch.setattr(java_contracts, "_converted", lambda text, names: F.struct(F.lit("{}").alias("schema"), F.lit("high").alias("level"), F.array_join(F.array_sort(F.transform(names, lambda x: x["key"])), " ").alias("reason"), F.array().alias("references")).cast(shape))
    assert {r["path"]: r["reason"] for r in java_contracts.bodies(handled, known).collect() if r["path"] != "/none"} == {f"/{k}": f"Box In{k} S{k}" for k in range(30)}
