"""Facts of Python sources, read from their syntax trees and never executed.

One row for each router, inclusion, route and parameter; a file that cannot be parsed gives one row of kind `error`. Values that are not literals are null.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
SCHEMA = "repo_id string, path string, module string, kind string, line int, value string"
#: What makes an object a service or a part of one: class name to (framework, role).
MAKERS = {"FastAPI": ("fastapi", "app"), "APIRouter": ("fastapi", "router"), "Flask": ("flask", "app"), "Blueprint": ("flask", "router")}
INCLUDES = {"include_router": "prefix", "register_blueprint": "url_prefix"}
MARKERS = {"Query": "query", "Path": "path", "Header": "header", "Cookie": "cookie", "Body": "body", "Form": "form", "File": "file"}
SIMPLE = {"int": "integer", "float": "number", "str": "string", "bool": "boolean", "bytes": "string", "datetime": "string", "date": "string", "UUID": "string", "Decimal": "string"}


# The parts of Flask's request by the places of what they hold.
REQUEST = {"args": "query", "form": "form", "files": "file", "headers": "header", "cookies": "cookie"}


def module_of(path: str) -> str:
    out = path.removesuffix(".py").replace("/", ".")
    return out.removesuffix(".__init__") if out != "__init__" else ""


def _literal(node):
    try:
        return ast.literal_eval(node) if node is not None else None
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None


def _name(node) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _words(call: ast.Call) -> dict:
    return {k.arg: k.value for k in call.keywords if k.arg}


class _Reader(ast.NodeVisitor):
    def __init__(self, module: str, package: bool):
        self.module, self.package, self.rows, self.names = module, package, [], {}

    def add(self, kind: str, node, **value):
        self.rows.append((kind, node.lineno, json.dumps(value)))

    def visit_Import(self, node):
        for a in node.names:
            self.names[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], None)

    def visit_ImportFrom(self, node):
        base = self.module.split(".")
        base = base[: len(base) - node.level + self.package] if node.level else []
        source = ".".join([*base, *([node.module] if node.module else [])])
        for a in node.names:
            self.names[a.asname or a.name] = (source, a.name)

    def target(self, node) -> list[list[str]]:
        """Where a router that an expression names may be defined: pairs of module and variable."""
        if isinstance(node, ast.Name):
            if node.id in self.names:
                source, name = self.names[node.id]
                return [[source, name]] if name else []
            return [[self.module, node.id]]
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in self.names:
            source, name = self.names[node.value.id]
            return [[f"{source}.{name}" if name else source, node.attr]]
        return []

    def visit_Assign(self, node):
        if isinstance(node.value, ast.Call) and _name(node.value.func) in MAKERS and isinstance(node.targets[0], ast.Name):
            framework, role = MAKERS[_name(node.value.func)]
            w = _words(node.value)
            self.add("router", node, framework=framework, role=role, name=node.targets[0].id, prefix=_literal(w.get("prefix") or w.get("url_prefix")) or "", title=_literal(w.get("title")), tags=_literal(w.get("tags")) or [])
        self.generic_visit(node)

    def visit_Expr(self, node):
        call = node.value
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in INCLUDES and call.args:
            w = _words(call)
            for module, name in self.target(call.args[0]):
                for own_module, own in self.target(call.func.value):
                    self.add("include", node, owner_module=own_module, owner=own, target_module=module, target=name, prefix=_literal(w.get(INCLUDES[call.func.attr])) or "", tags=_literal(w.get("tags")) or [])
        self.generic_visit(node)

    def visit_FunctionDef(self, node):
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute):
                w = _words(d)
                path = _literal(d.args[0]) if d.args else _literal(w.get("path") or w.get("rule"))
                verb = d.func.attr
                methods = [verb] if verb in METHODS else [str(m).lower() for m in _literal(w.get("methods")) or ["get"]] if verb in ("route", "api_route") else []
                if isinstance(path, str) and methods:
                    doc = (ast.get_docstring(node) or "").strip().split("\n")[0] or None
                    for module, name in self.target(d.func.value):
                        self.add("route", d, owner_module=module, owner=name, methods=methods, route=path, function=node.name, status=_literal(w.get("status_code")) if isinstance(_literal(w.get("status_code")), int) else None, summary=doc, parameters=self.parameters(node, path), requested=self.requested(node))
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def requested(self, node) -> list[dict]:
        """What a handler reads of Flask's request: arguments, forms, files, headers, cookies by name, and a JSON body."""
        if self.names.get("request") != ("flask", "request"):
            return []
        out: dict[tuple, dict] = {}
        own = lambda x, n: isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "request" and x.attr == n

        def add(name, where, required, type_="string"):
            out.setdefault((name, where), {"name": name, "location": where, "required": required, "type": type_, "ref": None})

        for x in ast.walk(node):
            if isinstance(x, ast.Call) and (own(x.func, "get_json")) or own(x, "json"):
                add("body", "body", True, "object")
            for attr, where in REQUEST.items():
                if isinstance(x, ast.Subscript) and own(x.value, attr) and isinstance(_literal(x.slice), str):
                    add(_literal(x.slice), where, True)
                elif isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("get", "getlist") and own(x.func.value, attr) and x.args and isinstance(_literal(x.args[0]), str):
                    kind = SIMPLE.get(_name(_words(x).get("type")) or "", "string")
                    add(_literal(x.args[0]), where, False, "array" if x.func.attr == "getlist" else kind)
        return list(out.values())

    def parameters(self, node, path: str) -> list[dict]:
        out, a = [], node.args
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        for arg, default in [*zip(plain, defaults, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)]:
            if arg.arg in ("self", "cls"):
                continue
            kind, marker = arg.annotation, default if isinstance(default, ast.Call) else None
            if isinstance(kind, ast.Subscript) and _name(kind.value) == "Annotated" and isinstance(kind.slice, ast.Tuple):
                marker = next((x for x in kind.slice.elts[1:] if isinstance(x, ast.Call)), marker)
                kind = kind.slice.elts[0]
            found = _name(marker.func) if marker is not None else None
            if found in ("Depends", "Security"):
                continue
            optional = default is not None and not (isinstance(default, ast.Call) and default is marker)
            if isinstance(kind, ast.BinOp) or isinstance(kind, ast.Subscript) and _name(kind.value) == "Optional":
                kind = kind.left if isinstance(kind, ast.BinOp) else kind.slice
            type_name = _name(kind.value if isinstance(kind, ast.Subscript) else kind) if kind is not None else None
            if type_name in ("Request", "Response", "BackgroundTasks", "WebSocket"):
                continue
            given = default is marker and marker is not None and marker.args and not (isinstance(marker.args[0], ast.Constant) and marker.args[0].value is Ellipsis)
            in_path = f"{{{arg.arg}}}" in path or f"{{{arg.arg}:" in path or f"<{arg.arg}>" in path or f":{arg.arg}>" in path
            if found in MARKERS:
                where = MARKERS[found]
            elif in_path:
                where = "path"
            elif type_name == "UploadFile":
                where = "file"
            elif type_name is None or type_name in SIMPLE or type_name in ("list", "List", "set", "Literal", "Enum"):
                where = "query"
            else:
                where = "body"
            words = _words(marker) if marker is not None else {}
            name = _literal(words.get("alias")) or (arg.arg.replace("_", "-") if where == "header" else arg.arg)
            required = where == "path" or not (optional or given or "default" in words or "default_factory" in words)
            out.append({"name": name, "location": where, "required": required, "type": SIMPLE.get(type_name, "array" if type_name in ("list", "List", "set") else "object" if where == "body" else "string"), "ref": type_name if where == "body" else None})
        return out


def _facts(batches):
    for b in batches:
        rows = []
        for repo, path, raw in zip(b.column("repo_id").to_pylist(), b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            module = module_of(path)
            try:
                tree = ast.parse((raw or b"").decode("utf-8", "replace"))
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                rows.append((repo, path, module, "error", getattr(e, "lineno", None) or 0, json.dumps({"message": str(e)})))
                continue
            reader = _Reader(module, path.endswith("__init__.py"))
            reader.visit(tree)
            rows += [(repo, path, module, *r) for r in reader.rows]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], ["repo_id", "path", "module", "kind", "line", "value"])


def facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, module, kind, line, value JSON) of the Python files."""
    return files.where(F.col("path").endswith(".py")).select("repo_id", "path", "content").mapInArrow(_facts, SCHEMA)
