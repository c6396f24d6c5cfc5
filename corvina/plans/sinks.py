"""Documents and reports as files."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.yaml_text import dump, load


def canonical_json(value) -> str:
    """Keys sorted, nulls of objects dropped, no blanks, a newline at the end."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if v is not None}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"


def write_text(path: str | Path, text: str) -> None:
    """Writes a file at once: others see the old one or the whole new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def service_paths(documents: DataFrame, base: str) -> DataFrame:
    """documents with the file of each: base itself for a repository's only service, else base with the service's name before the suffix."""
    stem, suffix = os.path.splitext(base)
    count = documents.groupBy("repo_id").agg(F.count("*").alias("_n"))
    safe = F.regexp_replace("service", "[^A-Za-z0-9_.-]+", "_")
    return documents.join(count, "repo_id").withColumn("file", F.when(F.col("_n") == 1, base).otherwise(F.concat(F.lit(f"{stem}."), safe, F.lit(suffix)))).drop("_n")


def catalog(paths: DataFrame) -> DataFrame:
    """(repo_id, catalog JSON) of repositories with more than one service."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("service").alias("id"), F.col("file").alias("spec"))))
    return paths.groupBy("repo_id").agg(entries.alias("e")).where(F.size("e") > 1).select("repo_id", F.to_json("e").alias("catalog"))


def dumped(document: dict, kind: str) -> str:
    """A document as JSON or YAML, its keys in their order."""
    if kind == "yaml":
        return dump(document)
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def write_document(document: dict, path: str | Path, kind: str) -> Path:
    """Writes a document that reads back as the same value; a file of another kind's suffix gets the right one."""
    path = Path(path)
    if path.suffix not in {"yaml": (".yaml", ".yml"), "json": (".json",)}[kind]:
        path = path.with_suffix(f".{kind}")
    text = dumped(document, kind)
    if (load(text) if kind == "yaml" else json.loads(text)) != document:
        raise ValueError(f"{path}: the document does not read back as it is")
    write_text(path, text)
    return path


def write_documents(documents: DataFrame, folder: str, base: str = "openapi.json") -> int:
    """Writes one file a service below folder/repo_id and a catalog where there are several; how many documents there were.

    Each task writes its own documents, at once: folder is one that executors share.
    """
    kind = "yaml" if base.endswith((".yaml", ".yml")) else "json"
    rows = service_paths(documents, base)

    def run(batches):
        for b in batches:
            for repo, file, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                write_document(json.loads(text), Path(folder, repo, file), kind)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    n = rows.select("repo_id", "file", "document").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    for r in catalog(rows).toLocalIterator():
        write_text(Path(folder, r["repo_id"], "catalog.json"), canonical_json(json.loads(r["catalog"])))
    return n or 0


def write_reports(services: DataFrame, overall: DataFrame, path: str | Path) -> Path:
    """Writes the readiness of all services as one report."""
    rows = [json.loads(r["j"]) for r in services.orderBy("repo_id", "service").select(F.to_json(F.struct(*services.columns)).alias("j")).toLocalIterator()]
    whole = overall.first().asDict()
    write_text(path, canonical_json({**whole, "service_reports": rows}))
    return Path(path)


def read_report(path: str | Path) -> dict:
    """A report; one without its parts is an error."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict) or not isinstance(value.get("service_reports"), list) or "readiness" not in value:
        raise ValueError(f"{path}: not a report")
    return value


def report_table(report: dict) -> str:
    """A report as lines of text."""
    head = ["service", "operations", "readiness", "gates", "ready"]
    rows = [[str(s["service"]), str(s["operations"]), f"{s['readiness']:.1f}", f"{s['gates_passed']}/{s['gates']}", "yes" if s["production_ready"] else "no"] for s in report["service_reports"]]
    rows.append(["overall", str(sum(int(r[1]) for r in rows)), f"{report['readiness'] or 0:.1f}", "", "yes" if report["production_ready"] else "no"])
    widths = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in [head, *rows]]
    issues = [f"- {s['service']}: {i}" for s in report["service_reports"] for i in s.get("issues", [])]
    return "\n".join([*lines, *issues]) + "\n"
