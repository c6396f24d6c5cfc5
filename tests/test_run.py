"""Source trees through the whole run: own fixtures, from files to documents, gates and reports."""

import json
import threading
import urllib.request

import pytest

from corvina import cli, config, serve
from corvina.plans import metadata, run, sinks, validation
from corvina.sources import tree

POM = "<project xmlns='http://maven.apache.org/POM/4.0.0'><artifactId>{}</artifactId><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-{}</artifactId></dependency></dependencies></project>"
BOOKS = {
    "pom.xml": POM.format("bookstore", "web"),
    "src/main/resources/application.properties": "server.servlet.context-path=/api\n",
    "src/main/java/com/b/BookController.java": """package com.b;
import com.b.dto.*; import org.springframework.web.bind.annotation.*; import com.b.err.MissingException;
@RestController @RequestMapping("/v1/books")
public class BookController {
    private final BookService service;
    @GetMapping public ResponseEntity<PageOf<Book>> list(@RequestParam(defaultValue = "0") int page) { return ResponseEntity.ok(service.all()); }
    @PostMapping @PreAuthorize("hasRole('A')") public ResponseEntity<Book> create(@Valid @RequestBody NewBook body) { return ResponseEntity.status(HttpStatus.CREATED).body(service.add(body)); }
    @GetMapping("/{id}") public Book one(@PathVariable long id) { return service.find(id); }
    @PutMapping("/{id}") public Book put(@PathVariable long id, @RequestBody NewBook body) { throw new ResponseStatusException(HttpStatus.CONFLICT, "x"); }
    @DeleteMapping("/{id}") public ResponseEntity<Void> drop(@PathVariable long id) { return ResponseEntity.noContent().build(); }
    @PostMapping("/{id}/cover") public ResponseEntity<Void> cover(@PathVariable long id, @RequestPart("file") MultipartFile file) { return ResponseEntity.accepted().build(); }
}
""",
    "src/main/java/com/b/BookService.java": "package com.b; import com.b.dto.Book; class BookService { Book find(long id) { return load(id); } private Book load(long id) { if (id < 0) throw new com.b.err.MissingException(\"no\"); throw new Odd(); } PageOf<Book> all() { return null; } }",
    "src/main/java/com/b/err/MissingException.java": "package com.b.err; @ResponseStatus(HttpStatus.NOT_FOUND) public class MissingException extends RuntimeException {}",
    "src/main/java/com/b/Advice.java": "package com.b; import com.b.dto.ErrorBody; @RestControllerAdvice class Advice { @ExceptionHandler(Odd.class) @ResponseStatus(HttpStatus.GONE) public ErrorBody odd(Odd e) { return null; } } class Odd extends RuntimeException {}",
    "src/main/java/com/b/Security.java": "package com.b; @Configuration class Security { @Bean SecurityFilterChain chain(HttpSecurity http) { return http.authorizeHttpRequests(a -> a.requestMatchers(\"/api/v1/books/*\").permitAll().requestMatchers(\"/api/v1/books/*/cover\").authenticated().anyRequest().authenticated()).addFilterBefore(new JwtFilter(), X.class).build(); } }",
    "src/main/java/com/b/dto/Dtos.java": """package com.b.dto;
/** A book. */
public class Book extends Base { @NotBlank @Size(max = 200) private String title; @JsonProperty("authorName") private String author; private Genre genre; private List<String> tags; @JsonIgnore private String note; private static int n = 1; private Book sequel; }
class Base { private long id; }
class PageOf<T> { private List<T> items; private long total; }
enum Genre { FICTION, SCIENCE; }
record NewBook(@NotNull @Size(min = 1, max = 200) String title, @Pattern(regexp = "[0-9]+") String isbn, @Min(1450) @Max(2100) int year) {}
record ErrorBody(String message, String code) {}
""",
    "src/test/java/com/b/TestController.java": "@RestController class TestController { @GetMapping(\"/no\") void no() {} }",
}
ITEMS = {
    "pom.xml": "<project><artifactId>inventory</artifactId></project>",
    "App.java": "import jakarta.ws.rs.ApplicationPath; @ApplicationPath(\"/api\") public class App {}",
    "Items.java": """import jakarta.ws.rs.*;
@Path("/items") public class Items {
    @GET public List<Item> all(@QueryParam("n") @DefaultValue("5") int n) { return null; }
    @POST public Response add(Item item) { return Response.status(Response.Status.CREATED).entity(item).build(); }
    @GET @Path("/{id: [0-9]+}") public Item one(@PathParam("id") long id) { throw new NotFoundException(); }
    @PUT @Path("/{id}") public Item put(@PathParam("id") long id, Item item) { throw new Full(); }
    @DELETE @Path("/{id}") public void drop(@PathParam("id") long id) {}
}
class Item { @NotBlank String name; @PositiveOrZero int quantity; }
class FullMapper implements ExceptionMapper<Full> { public Response toResponse(Full e) { return Response.status(409).build(); } }
class Full extends RuntimeException {}
""",
}
SHOP = {
    "requirements.txt": "fastapi\n",
    "shop/main.py": "from fastapi import FastAPI\nfrom pydantic import BaseModel\napp = FastAPI()\nclass Cart(BaseModel):\n    sku: str\n@app.post('/checkout', response_model=Cart)\ndef checkout(cart: Cart):\n    ...\n@app.get('/internal/x')\ndef x(): ...\n",
    "shop/tests/fake.py": "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/no')\ndef no(): ...\n",
}
TREES = {"books": BOOKS, "items": ITEMS, "shop": SHOP, "none": {"README.md": "x"}}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(repo, p, len(t), bytearray(t.encode())) for repo, own in TREES.items() for p, t in own.items()]
    return tree.kept(spark.createDataFrame(rows, tree.FILES).repartition(4)).cache()


@pytest.fixture(scope="module")
def settings():
    return config.settings({"document": {"servers": [{"url": "http://h/api"}]}, "validation": {"strict": True}}, environment={})


@pytest.fixture(scope="module")
def found(files, settings):
    return run.analyze(files, settings)


@pytest.fixture(scope="module")
def made(found):
    return run.generate(found)


@pytest.fixture(scope="module")
def documents(made):
    return {r["repo_id"]: json.loads(r["document"]) for r in made.documents.collect()}


def test_operations(found, documents):
    got = {(r["repo_id"], r["service"], r["path"], r["method"]) for r in found.operations.collect()}
    books = {("books", "bookstore", f"/api/v1/books{p}", m) for p, m in [("", "get"), ("", "post"), ("/{id}", "get"), ("/{id}", "put"), ("/{id}", "delete"), ("/{id}/cover", "post")]}
    items = {("items", "inventory", f"/api/items{p}", m) for p, m in [("", "get"), ("", "post"), ("/{id}", "get"), ("/{id}", "put"), ("/{id}", "delete")]}
    assert got == books | items | {("shop", "shop/main.py:app", "/checkout", "post"), ("shop", "shop/main.py:app", "/internal/x", "get")}
    assert set(documents["shop"]["paths"]) == {"/checkout"} and documents["shop"]["servers"] == [{"url": "http://h/api"}]
    assert documents["items"]["servers"] == [{"url": "http://h"}]
    assert {(r["repo_id"], r["code"]) for r in found.warnings.collect()} == {("none", "W001")}


def test_java_schemas(documents):
    own = documents["books"]["components"]["schemas"]
    ref = lambda n: {"$ref": f"#/components/schemas/{n}"}
    assert own["Book"] == {"type": "object", "description": "A book.", "required": ["title"], "properties": {"id": {"type": "integer", "format": "int64"}, "title": {"type": "string", "minLength": 1, "maxLength": 200}, "authorName": {"type": "string"}, "genre": ref("Genre"), "tags": {"type": "array", "items": {"type": "string"}}, "sequel": ref("Book")}}
    assert own["PageOfBook"] == {"type": "object", "properties": {"items": {"type": "array", "items": ref("Book")}, "total": {"type": "integer", "format": "int64"}}}
    assert own["Genre"] == {"type": "string", "enum": ["FICTION", "SCIENCE"]}
    assert own["NewBook"] == {"type": "object", "required": ["title"], "properties": {"title": {"type": "string", "minLength": 1, "maxLength": 200}, "isbn": {"type": "string", "pattern": "^(?:[0-9]+)$"}, "year": {"type": "integer", "format": "int32", "minimum": 1450, "maximum": 2100}}}
    assert set(own) == {"Book", "PageOfBook", "Genre", "NewBook", "ErrorBody"}
    assert documents["items"]["components"]["schemas"]["Item"]["properties"] == {"name": {"type": "string", "minLength": 1}, "quantity": {"type": "integer", "format": "int32", "minimum": 0}}


def test_java_answers(documents):
    paths = documents["books"]["paths"]
    answers = lambda p, m: {s: r.get("content", {}).get("application/json", {}).get("schema", {}).get("$ref", "").rpartition("/")[2] for s, r in paths[f"/api/v1/books{p}"][m]["responses"].items()}
    assert answers("", "get") == {"200": "PageOfBook"} and answers("", "post") == {"201": "Book", "400": "ErrorBody"}
    assert answers("/{id}", "get") == {"200": "Book", "404": "ErrorBody", "410": "ErrorBody"} and answers("/{id}", "put") == {"200": "Book", "409": "ErrorBody"}
    assert answers("/{id}", "delete") == {"204": ""} and answers("/{id}/cover", "post") == {"202": ""}
    assert paths["/api/v1/books"]["post"]["requestBody"]["content"]["application/json"]["schema"] == {"$ref": "#/components/schemas/NewBook"}
    items = documents["items"]["paths"]
    assert {(p, m): set(o["responses"]) for p, own in items.items() for m, o in own.items()} == {("/api/items", "get"): {"200"}, ("/api/items", "post"): {"201"}, ("/api/items/{id}", "get"): {"200", "404"}, ("/api/items/{id}", "put"): {"200", "409"}, ("/api/items/{id}", "delete"): {"204"}}


def test_java_security(documents):
    doc = documents["books"]
    assert doc["components"]["securitySchemes"] == {"bearerAuth": {"type": "http", "scheme": "bearer", "bearerFormat": "JWT"}}
    secured = {(p, m) for p, own in doc["paths"].items() for m, o in own.items() if o.get("security")}
    assert secured == {("/api/v1/books", "get"), ("/api/v1/books", "post"), ("/api/v1/books/{id}/cover", "post")}
    assert "securitySchemes" not in documents["items"].get("components", {})


def test_gates_and_report(made):
    gates = made.gates.collect()
    assert len(gates) == 3 * 7 and [r for r in gates if not r["passed"]] == []
    assert made.errors.collect() == []
    whole = made.overall.first()
    assert whole["services"] == 3 and whole["strict_ok"] and 0 < whole["readiness"] <= 100


def test_each_gate_fails_alone(spark, found, made):
    own = found.operations.where("repo_id = 'books'")
    statuses, secured = found.statuses.where("repo_id = 'books'"), found.parts["security"].where("repo_id = 'books'")
    doc = json.loads(made.documents.where("repo_id = 'books'").first()["document"])
    at = lambda d: d["paths"]["/api/v1/books/{id}"]
    changes = {
        "unique_operation_ids": lambda d: at(d)["put"].update(operationId=at(d)["get"]["operationId"]),
        "path_params_declared": lambda d: at(d)["put"].pop("parameters"),
        "valid_status_keys": lambda d: at(d)["put"]["responses"].update({"20x": {"description": "x"}}),
        "endpoint_coverage": lambda d: at(d).pop("put"),
        "no_invented_operations": lambda d: d["paths"].update({"/new": {"get": {"responses": {}}}}),
        "no_invented_details": lambda d: at(d)["put"]["responses"].update({"418": {"description": "x"}}),
        "strict_high_confidence_preserved": lambda d: at(d)["put"]["responses"].pop("409"),
    }
    for name, change in changes.items():
        other = json.loads(json.dumps(doc))
        change(other)
        one = spark.createDataFrame([("books", "bookstore", json.dumps(other))], "repo_id string, service string, document string")
        failed = {r["gate"] for r in validation.gates(one, own, statuses, secured, high=own.where("NOT duplicate")).where("NOT passed").collect()}
        assert failed == ({name, "no_invented_details"} if name == "valid_status_keys" else {name}), name
    for change in (lambda d: at(d)["put"]["parameters"].append({"name": "q", "in": "query"}), lambda d: at(d)["put"].update(security=[{"other": []}]), lambda d: at(d)["get"].update(requestBody={})):
        other = json.loads(json.dumps(doc))
        change(other)
        one = spark.createDataFrame([("books", "bookstore", json.dumps(other))], "repo_id string, service string, document string")
        assert {r["gate"] for r in validation.gates(one, own, statuses, secured).where("NOT passed").collect()} == {"no_invented_details"}


def test_structure():
    good = {"openapi": "3.1.0", "info": {"title": "t", "version": "1"}, "paths": {"/x/{i}": {"get": {"parameters": [{"name": "i", "in": "path", "required": True, "schema": {"type": "string"}}], "responses": {"200": {"description": "x", "content": {"a/b": {"schema": {"$ref": "#/components/schemas/A~1b"}}}}}}}}, "components": {"schemas": {"A/b": {"type": ["object", "null"], "properties": {"p": True}}}}}
    assert validation.problems(good) == []
    bad = json.loads(json.dumps(good).replace("A~1b", "C").replace('"3.1.0"', '"3.0"').replace('["object", "null"]', '"thing"'))
    bad["paths"]["x"] = {"fetch": {}, "put": {"parameters": [{"name": "a", "in": "path", "schema": {"pattern": "("}}] * 2, "security": [{"s": []}]}}
    assert len(validation.problems(bad)) >= 9 and validation.problems([]) and validation.pointed(good, "/components/schemas/A~1b/type/1") == (True, "null")


def test_metadata_is_canonical(found, made, tmp_path):
    (text,) = [r["metadata"] for r in made.metadata.where("repo_id = 'books'").collect()]
    again = metadata.documents(found.operations.repartition(7, "method"), found.statuses, found.parts["security"], found.warnings).where("repo_id = 'books'").first()["metadata"]
    assert text == again and text.endswith("}\n") and metadata.problems(json.loads(text)) == []
    value = json.loads(text)
    assert [o["method"] for o in value["services"][0]["endpoints"][1]["operations"]] == ["get", "put", "delete"]
    value["services"][0].pop("framework")
    (tmp_path / "m.json").write_text(json.dumps(value))
    with pytest.raises(ValueError, match="framework"):
        metadata.load(tmp_path / "m.json")


def test_filters(files):
    only = run.analyze(files.where("repo_id IN ('books', 'shop')"), config.settings({"analysis": {"language": "python"}}, environment={}))
    assert {r["repo_id"] for r in only.operations.collect()} == {"shop"}
    with pytest.raises(ValueError, match="rails"):
        run.analyze(files, config.settings({"analysis": {"frameworks": ["rails"]}}, environment={}))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    for repo in ("items", "shop"):
        for p, t in TREES[repo].items():
            to = tmp_path / "in" / repo / p
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(t)
    (tmp_path / "c.yaml").write_text("output:\n  format: json\n")
    out = tmp_path / "out"
    code = cli.main(["--config", str(tmp_path / "c.yaml"), "run", "--root", str(tmp_path / "in"), "--output", str(out / "api.yaml"), "--metadata-output", str(out / "meta.json"), "--report-output", str(out / "report.json"), "--strict"])
    assert code == 0 and "overall" in capsys.readouterr().out
    document = json.loads((out / "items" / "api.json").read_text())
    assert set(document["paths"]) == {"/api/items", "/api/items/{id}"} and metadata.load(out / "shop" / "meta.json")["repository"] == "shop"
    assert cli.main(["validate", str(out / "items" / "api.json")]) == 0 and cli.main(["report", str(out / "report.json")]) == 0 and cli.main(["schema"]) == 0
    document["openapi"] = "2"
    (out / "bad.json").write_text(json.dumps(document))
    assert cli.main(["validate", str(out / "bad.json")]) == 1 and cli.main(["--config", str(tmp_path / "none.yaml"), "schema"]) == 2
    assert sinks.write_document(document, out / "x.json", "yaml").name == "x.yaml"
    with serve.server(out / "bad.json", 0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{s.server_address[1]}"
        assert urllib.request.urlopen(f"{base}/").status == 200 and json.loads(urllib.request.urlopen(f"{base}/openapi.json").read()) == document
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{base}/other")
        s.shutdown()
    assert run.commit_of(tmp_path) is None
