"""Facts of Java sources of annotated web controllers, read by a tokenizer that does not stop at errors.

One row for each annotated type with its mappings, and one for each mapped method with its parameters. Sources are never compiled or executed.
"""

from __future__ import annotations

import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "repo_id string, path string, kind string, line int, value string"
TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[A-Za-z_$][\w$]*|\d[\w.]*|\S', re.S)
VERBS = {"GetMapping": "get", "PostMapping": "post", "PutMapping": "put", "DeleteMapping": "delete", "PatchMapping": "patch"}
JAX = {"GET": "get", "POST": "post", "PUT": "put", "DELETE": "delete", "PATCH": "patch", "HEAD": "head", "OPTIONS": "options"}
PLACES = {"PathVariable": "path", "RequestParam": "query", "RequestHeader": "header", "CookieValue": "cookie", "RequestBody": "body", "RequestPart": "file", "PathParam": "path", "QueryParam": "query", "HeaderParam": "header", "CookieParam": "cookie", "FormParam": "form"}
TYPES = {"int": "integer", "long": "integer", "short": "integer", "Integer": "integer", "Long": "integer", "float": "number", "double": "number", "Double": "number", "BigDecimal": "number", "boolean": "boolean", "Boolean": "boolean", "List": "array", "Set": "array"}


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, line) without comments."""
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(("//", "/*")):
            out.append((m[0], line))
    return out


def _closing(t: list, at: int, pair: str) -> int:
    """The place of what closes the bracket at `at`, or the end."""
    depth = 0
    for k in range(at, len(t)):
        depth += (t[k][0] == pair[0]) - (t[k][0] == pair[1])
        if not depth:
            return k
    return len(t) - 1


def _texts(part: list) -> list[str]:
    return [x[1:-1] for x, _ in part if x[:1] == '"' and not x.startswith('"""')]


def _split(part: list) -> list[list]:
    """Parts between commas that no bracket encloses."""
    out, depth = [[]], 0
    for x in part:
        depth += (x[0] in "([{<") - (x[0] in ")]}>")
        if x[0] == "," and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return [p for p in out if p]


def annotation(t: list, at: int) -> tuple[str, dict[str, list], int]:
    """(simple name, arguments by name, next place) of the annotation whose @ is at `at`."""
    k = at + 1
    name = t[k][0]
    while k + 2 < len(t) and t[k + 1][0] == ".":
        k += 2
        name = t[k][0]
    args: dict[str, list] = {}
    if k + 1 < len(t) and t[k + 1][0] == "(":
        end = _closing(t, k + 1, "()")
        for p in _split(t[k + 2 : end]):
            if len(p) > 2 and p[1][0] == "=":
                args[p[0][0]] = p[2:]
            else:
                args["value"] = p
        k = end
    return name, args, k + 1


def _paths(args: dict) -> list[str]:
    return _texts(args.get("value") or args.get("path") or []) or [""]


def _parameters(part: list) -> list[dict]:
    out = []
    for p in _split(part):
        found, k = {}, 0
        while k < len(p) and (p[k][0] == "@" or p[k][0] == "final"):
            if p[k][0] == "final":
                k += 1
                continue
            name, args, k = annotation(p, k)
            found[name] = args
        rest = [x for x, _ in p[k:]]
        where = next((n for n in found if n in PLACES), None)
        if not rest or where is None and not any(n.endswith("Param") or n == "Valid" for n in found):
            continue
        args = found.get(where, {})
        given = _texts(args.get("value") or args.get("name") or [])
        place = PLACES.get(where, "body")
        optional = [x for x, _ in args.get("required", [])] == ["false"] or "defaultValue" in args or "DefaultValue" in found or rest[0] == "Optional"
        required = place == "path" or not optional and (where or "").startswith(("Request", "Cookie"))
        out.append({"name": given[0] if given else rest[-1], "location": place, "required": required, "type": TYPES.get(rest[0], "object" if place == "body" else "string"), "ref": rest[0] if place == "body" else None})
    return out


def routes(text: str) -> list[tuple[str, int, dict]]:
    """(kind, line, value) of controllers and their mapped methods."""
    t, out, k = tokens(text), [], 0
    pending: list = []
    owner, depth, at_depth = None, 0, []
    while k < len(t):
        x, line = t[k]
        if x == "@" and k + 1 < len(t) and t[k + 1][0] != "interface":
            name, args, k = annotation(t, k)
            pending.append((name, args, line))
            continue
        if x in ("class", "interface", "record", "enum") and k + 1 < len(t) and re.match(r"[A-Za-z_]", t[k + 1][0]) and (k == 0 or t[k - 1][0] != "."):
            names = {n: a for n, a, _ in pending}
            if names.keys() & {"RestController", "Controller", "Path"}:
                prefixes = _paths(names.get("RequestMapping") or names.get("Path") or {})
                owner = {"name": t[k + 1][0], "prefixes": prefixes, "framework": "jaxrs" if "Path" in names else "spring"}
                at_depth.append((depth, owner))
                out.append(("controller", line, owner))
            pending = []
        elif x == "{":
            depth += 1
            pending = []
        elif x == "}":
            depth -= 1
            if at_depth and depth <= at_depth[-1][0]:
                at_depth.pop()
                owner = at_depth[-1][1] if at_depth else None
        elif x == ";":
            pending = []
        elif x == "(" and owner and depth == at_depth[-1][0] + 1 and pending and k and re.match(r"[A-Za-z_]", t[k - 1][0]):
            end = _closing(t, k, "()")
            names = {n: a for n, a, _ in pending}
            verbs = [(VERBS[n], p) for n, a in names.items() if n in VERBS for p in _paths(a)]
            if "RequestMapping" in names:
                a = names["RequestMapping"]
                verbs += [(m, p) for m in [w.lower() for w, _ in a.get("method", []) if w.lower() in VERBS.values()] or ["get"] for p in _paths(a)]
            verbs += [(JAX[n], _paths(names.get("Path") or {})[0]) for n in names if n in JAX]
            status = next((w for w, _ in reversed(names.get("ResponseStatus", {}).get("value", []) or names.get("ResponseStatus", {}).get("code", []))), None)
            for prefix, (method, path) in itertools.product(owner["prefixes"], verbs):
                out.append(("route", pending[0][2], {"owner": owner["name"], "framework": owner["framework"], "prefix": prefix, "method": method, "route": path, "function": t[k - 1][0], "status": status, "parameters": _parameters(t[k + 1 : end])}))
            pending = []
            k = end
        k += 1
    return out


def functional(text: str) -> list[tuple[str, int, dict]]:
    """(kind, line, value) of routes that router functions state as GET("/path") and the like, with the prefixes of enclosing nests."""
    t = tokens(text)
    if not any(x == "RouterFunction" for x, _ in t):
        return []
    owner = next((t[k + 1][0] for k in range(len(t) - 1) if t[k][0] == "class"), "")
    quoted = lambda k: k < len(t) and t[k][0][:1] == '"' and not t[k][0].startswith('"""')
    nests, out = [], []
    for k, (x, line) in enumerate(t):
        if k + 2 >= len(t) or t[k + 1][0] != "(" or k and t[k - 1][0] == "@":
            continue
        if x == "nest" and t[k + 2][0] in ("path", "RequestPredicates"):
            at = next((j for j in range(k + 2, _closing(t, k + 1, "()")) if quoted(j)), None)
            if at is not None:
                nests.append((k, _closing(t, k + 1, "()"), t[at][0][1:-1]))
        elif x == "path" and quoted(k + 2) and k + 3 < len(t) and t[k + 3][0] == ",":
            nests.append((k, _closing(t, k + 1, "()"), t[k + 2][0][1:-1]))
        elif x in JAX and quoted(k + 2):
            end = _closing(t, k + 1, "()")
            # the handler comes within the same call, or right after the predicate's
            stop = next((j for j in range(end, len(t)) if t[j][0] in JAX or t[j][0] == ";"), len(t))
            named = next((t[j + 2][0] for j in range(k + 3, stop - 2) if t[j][0] == ":" and t[j + 1][0] == ":"), x.lower())
            prefix = "".join(p for a, b, p in nests if a < k <= b)
            route = t[k + 2][0][1:-1]
            inputs = [{"name": n, "location": "path", "required": True, "type": "string", "ref": None} for n in re.findall(r"\{\*?(\w+)", prefix + route)]
            out.append(("route", line, {"owner": owner, "framework": "spring-webflux", "prefix": prefix, "method": JAX[x], "route": route, "function": named, "status": None, "parameters": inputs}))
    return out


def _facts(batches):
    for b in batches:
        rows = [(repo, path, kind, line, json.dumps(value)) for repo, path, raw in zip(b.column("repo_id").to_pylist(), b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for source in [(raw or b"").decode("utf-8", "replace")] for kind, line, value in [*routes(source), *functional(source)]]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], ["repo_id", "path", "kind", "line", "value"])


def facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, line, value JSON) of the Java files."""
    return files.where(F.col("path").endswith(".java")).select("repo_id", "path", "content").mapInArrow(_facts, SCHEMA)
