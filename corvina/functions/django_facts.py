"""Facts of URL configurations, views and viewsets in Python sources, read from their syntax trees.

One row for each URL entry, inclusion, router registration, view and viewset action. Strings that are not literals are left out.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .python_facts import METHODS, SCHEMA, _literal, _name, _Reader, _words, module_of

# What the mixins of viewsets add, as (action, method, detail).
ACTIONS = {"list": ("get", False), "create": ("post", False), "retrieve": ("get", True), "update": ("put", True), "partial_update": ("patch", True), "destroy": ("delete", True)}
BASES = {"ModelViewSet": list(ACTIONS), "ReadOnlyModelViewSet": ["list", "retrieve"], "ListModelMixin": ["list"], "CreateModelMixin": ["create"], "RetrieveModelMixin": ["retrieve"], "UpdateModelMixin": ["update", "partial_update"], "DestroyModelMixin": ["destroy"]}
GENERIC = {"ListAPIView": ["get"], "CreateAPIView": ["post"], "RetrieveAPIView": ["get"], "UpdateAPIView": ["put", "patch"], "DestroyAPIView": ["delete"], "ListCreateAPIView": ["get", "post"], "RetrieveUpdateAPIView": ["get", "put", "patch"], "RetrieveDestroyAPIView": ["get", "delete"], "RetrieveUpdateDestroyAPIView": ["get", "put", "patch", "delete"]}


class _Urls(_Reader):
    def visit_Assign(self, node):
        if isinstance(node.targets[0], ast.Name) and node.targets[0].id == "ROOT_URLCONF" and isinstance(_literal(node.value), str):
            self.add("settings", node, root=_literal(node.value))
        self.generic_visit(node)

    def visit_Call(self, node):
        name = _name(node.func)
        if name in ("path", "re_path", "url") and len(node.args) > 1 and isinstance(_literal(node.args[0]), str):
            route, view = _literal(node.args[0]), node.args[1]
            if isinstance(view, ast.Call) and _name(view.func) == "include" and view.args:
                what = view.args[0].elts[0] if isinstance(view.args[0], ast.Tuple) and view.args[0].elts else view.args[0]
                if isinstance(_literal(what), str):
                    self.add("url_include", node, route=route, regex=name != "path", target=_literal(what), router=None)
                elif isinstance(what, ast.Attribute) and what.attr == "urls" and isinstance(what.value, ast.Name):
                    self.add("url_include", node, route=route, regex=name != "path", target=self.module, router=what.value.id)
                return
            if isinstance(view, ast.Call) and isinstance(view.func, ast.Attribute) and view.func.attr == "as_view":
                view = view.func.value
            for module, own in self.target(view):
                self.add("url", node, route=route, regex=name != "path", view_module=module, view=own)
        elif isinstance(node.func, ast.Attribute) and name == "register" and len(node.args) > 1 and isinstance(node.func.value, ast.Name) and isinstance(_literal(node.args[0]), str):
            for module, own in self.target(node.args[1]):
                self.add("register", node, router=node.func.value.id, route=_literal(node.args[0]), view_module=module, view=own)
        self.generic_visit(node)

    def visit_FunctionDef(self, node):
        methods = next((_literal(d.args[0]) for d in node.decorator_list if isinstance(d, ast.Call) and _name(d.func) in ("api_view", "require_http_methods") and d.args), None)
        self.add("view", node, name=node.name, methods=[str(m).lower() for m in methods or ["get"]], lookup=None, actions=[])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        bases = [_name(b) for b in node.bases]
        defined = {f.name: f for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))}
        fields = {t.id: _literal(a.value) for a in node.body if isinstance(a, ast.Assign) for t in a.targets if isinstance(t, ast.Name)}
        actions = [(a, *ACTIONS[a], "") for a in ACTIONS if a in defined or any(a in BASES.get(b, []) for b in bases)] if any(b and "ViewSet" in b for b in bases) else []
        for f in defined.values():
            d = next((d for d in f.decorator_list if isinstance(d, ast.Call) and _name(d.func) == "action"), None)
            if d is not None:
                w = _words(d)
                actions += [(f.name, m.lower(), bool(_literal(w.get("detail"))), _literal(w.get("url_path")) or f.name) for m in _literal(w.get("methods")) or ["get"]]
        methods = [m for m in METHODS if m in defined] or next((GENERIC[b] for b in bases if b in GENERIC), [])
        if actions or methods:
            lookup = fields.get("lookup_url_kwarg") or fields.get("lookup_field") or "pk"
            given = next((a.value for a in node.body if isinstance(a, ast.Assign) for t in a.targets if isinstance(t, ast.Name) and t.id == "serializer_class"), None)
            serializer = (self.target(given) if given is not None else []) or [[None, None]]
            self.add("view", node, name=node.name, serializer_module=serializer[0][0], serializer=serializer[0][1], methods=methods, lookup=lookup, actions=[{"action": a, "method": m, "detail": d, "extra": e} for a, m, d, e in actions])


def _facts(batches):
    for b in batches:
        rows = []
        for repo, path, raw in zip(b.column("repo_id").to_pylist(), b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                tree = ast.parse((raw or b"").decode("utf-8", "replace"))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue  # python_facts reports it
            reader = _Urls(module_of(path), path.endswith("__init__.py"))
            reader.visit(tree)
            rows += [(repo, path, reader.module, *r) for r in reader.rows]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], ["repo_id", "path", "module", "kind", "line", "value"])


def facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, module, kind, line, value JSON) of the Python files."""
    return files.where(F.col("path").endswith(".py")).select("repo_id", "path", "content").mapInArrow(_facts, SCHEMA)
