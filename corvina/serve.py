"""A small local server for one document: an index page, the document, nothing else."""

from __future__ import annotations

import html
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path


def server(document: str | Path, port: int = 8081, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound but not running yet; port 0 takes a free one."""
    path = Path(document)
    kind = "application/json" if path.suffix == ".json" else "application/yaml"
    name = f"/openapi{path.suffix}"

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path in ("/", "/index.html"):
                body, what = f"<!doctype html><title>{html.escape(path.name)}</title><h1>{html.escape(path.name)}</h1><p><a href='{name}'>document</a></p><pre>{html.escape(path.read_text(encoding='utf-8'))}</pre>".encode(), "text/html; charset=utf-8"
            elif self.path == name:
                body, what = path.read_bytes(), kind
            else:
                return self.send_error(404)
            self.send_response(200)
            self.send_header("Content-Type", what)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    if not path.is_file():
        raise FileNotFoundError(path)
    return ThreadingHTTPServer((host, port), Pages)
