"""The command line: run, validate, report, serve, schema.

Exit codes: 0 all is well, 1 a document is not valid, 2 a strict run failed or settings are wrong, 3 not ready for production where that is asked for.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import config, logs


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvina", description=__doc__.split("\n")[0])
    p.add_argument("--config", help="a YAML file with settings")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="read sources, write documents and a report")
    run.add_argument("--root")
    run.add_argument("--repository", help="the name of the one repository at root; without it, each directory below root is one")
    run.add_argument("--output", dest="openapi_path")
    run.add_argument("--metadata-output", dest="metadata_path")
    run.add_argument("--report-output", dest="report_path")
    run.add_argument("--format", choices=["yaml", "json"])
    run.add_argument("--language", choices=["python", "java"])
    run.add_argument("--framework", action="append", dest="frameworks")
    run.add_argument("--service", action="append", dest="services")
    run.add_argument("--strict", action="store_true", default=None)
    sub.add_parser("validate", help="check a document").add_argument("document")
    sub.add_parser("report", help="show a report").add_argument("report")
    serve = sub.add_parser("serve", help="show a document in a browser")
    serve.add_argument("document")
    serve.add_argument("--port", type=int)
    sub.add_parser("schema", help="print the JSON Schema of metadata")
    return p


def _layers(args: argparse.Namespace) -> dict:
    get = lambda *names: {n: getattr(args, n, None) for n in names}
    return {"root": getattr(args, "root", None), "output": get("openapi_path", "metadata_path", "report_path", "format"), "analysis": get("language", "frameworks", "services"), "validation": get("strict"), "serve": get("port")}


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    log = logs.configure(args.verbose)
    try:
        settings = config.settings(_layers(args), args.config)
    except (ValueError, OSError) as e:
        log.error("%s", e)
        return 2
    logs.register_secret(settings.texts.api_key)
    if args.command == "schema":
        from .plans import metadata

        print(json.dumps(metadata.schema(), indent=2))
        return 0
    if args.command == "report":
        from .plans import sinks

        print(sinks.report_table(sinks.read_report(args.report)), end="")
        return 0
    if args.command == "serve":
        from .serve import server

        with server(args.document, settings.serve.port) as s:
            log.info("http://%s:%s/", *s.server_address[:2])
            s.serve_forever()
        return 0
    if args.command == "validate":
        from .functions.yaml_text import load
        from .plans import validation

        text = Path(args.document).read_text(encoding="utf-8")
        found = validation.problems(json.loads(text) if args.document.endswith(".json") else load(text))
        print("\n".join(found) or "valid")
        return 1 if found else 0
    return _run(args, settings, log)


def _run(args, settings, log) -> int:
    from pyspark.sql import SparkSession

    from .plans import run, sinks

    spark = SparkSession.builder.appName("corvina").getOrCreate()
    try:
        made, places = run.run(spark, settings, args.repository)
    except ValueError as e:
        log.error("%s", e)
        return 2
    print(sinks.report_table(sinks.read_report(places["report"])), end="")
    log.info("%s documents; report %s", places["documents"], places["report"])
    if not made.errors.isEmpty():
        return 1
    whole = made.overall.first()
    if settings.validation.strict and not whole["strict_ok"]:
        return 2
    return 3 if settings.quality.fail_on_not_production and not whole["production_ready"] else 0


if __name__ == "__main__":
    sys.exit(main())
