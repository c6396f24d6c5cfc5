"""From source trees to documents: files, readers, facts, operations, contracts, documents, gates, readiness, files again.

All repositories of a table of files go through together: every step is a join or an aggregation by repository, service and operation, and what is needed twice is kept in the shared folder.
"""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import django_facts, java_facts, java_types, paths, python_facts, python_types
from ..operators.storage import cut
from ..sources import tree
from . import adapters, contracts, django_services, enrichment, java_contracts, java_services, metadata, report, services, sinks, validation

KEY = ["repo_id", "service", "path", "method"]
#: Readers by the frameworks whose operations they read, and their languages.
READERS = {"fastapi": ["fastapi"], "flask": ["flask"], "django": ["django"], "spring": ["spring-mvc", "spring-webflux"], "spring-webflux": ["spring-webflux"], "jaxrs": ["jaxrs"]}
LANGUAGES = {"fastapi": "python", "flask": "python", "django": "python", "spring-mvc": "java", "spring-webflux": "java", "jaxrs": "java"}


@dataclass
class Analysis:
    """Tables of all repositories: what phase one finds."""

    operations: DataFrame
    parts: dict[str, DataFrame]
    statuses: DataFrame
    warnings: DataFrame
    readers: DataFrame
    settings: Settings = field(default_factory=Settings)


def readers(files: DataFrame, manifests: DataFrame, settings: Settings) -> DataFrame:
    """(repo_id, adapter, score, rank): the readers that each repository calls for; only the settings' languages and frameworks, if they name any."""
    unknown = sorted(set(settings.analysis.frameworks) - LANGUAGES.keys())
    if unknown:
        raise ValueError(f"unknown frameworks: {', '.join(unknown)}")
    rows = adapters.active(adapters.scores(adapters.signals(files, manifests)))
    if settings.analysis.frameworks:
        rows = rows.where(F.col("adapter").isin(settings.analysis.frameworks))
    if settings.analysis.language:
        rows = rows.where(F.col("adapter").isin([k for k, v in LANGUAGES.items() if v == settings.analysis.language]))
    return rows


def analyze(files: DataFrame, settings: Settings | None = None) -> Analysis:
    """What the sources of files(repo_id, path, length, content) say."""
    settings = settings or Settings()
    manifests = cut(tree.manifests(files))
    chosen = cut(readers(files, manifests, settings))
    found = cut(python_facts.facts(files))
    typed = cut(python_types.facts(files))
    types = cut(java_types.types(files))
    modules = cut(java_services.modules(manifests))
    urls = cut(django_facts.facts(files))
    python = services.operations(found).unionByName(django_services.operations(urls))
    java = java_services.operations(java_facts.facts(files), manifests, files, types)
    pairs = F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(a).alias("adapter")) for f, every in READERS.items() for a in every])
    allowed = chosen.select("repo_id", "adapter").join(files.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*"), "adapter").select("repo_id", "framework").distinct()
    wanted = lambda rows: cut((rows.where(F.col("service").isin(settings.analysis.services)) if settings.analysis.services else rows).join(allowed, ["repo_id", "framework"], "left_semi"))
    python, java = wanted(python), wanted(java)
    java_parts = java_contracts.parts(java, types, modules)
    success = cut(java_parts.pop("statuses"))
    java = java.drop("statuses").join(success.drop("created"), KEY, "left").withColumn("statuses", F.coalesce("statuses", F.array(F.lit("200"))))
    operations = cut(python.unionByName(java))
    python_parts = contracts.parts(python, typed)
    seen, patched = django_services.bodies(python, urls, typed)
    python_parts["schemas"] = cut(python_parts["schemas"])
    python_parts["schemas"] = python_parts["schemas"].unionByName(contracts.partial(python_parts["schemas"], patched))
    python_parts["bodies"] = python_parts["bodies"].join(seen.select(*KEY), KEY, "left_anti").unionByName(seen)
    parts = {k: cut(v) for k, v in contracts.joined_parts(python_parts, java_parts).items()}
    statuses = operations.where("NOT duplicate").select(*KEY, F.explode("statuses").alias("status")).unionByName(parts["errors"].select(*KEY, "status")).distinct()
    told = services.warnings(operations, found).unionByName(_without_readers(files, chosen))
    return Analysis(operations, parts, cut(statuses), cut(told), chosen, settings)


def _without_readers(files: DataFrame, chosen: DataFrame) -> DataFrame:
    none = files.select("repo_id").distinct().join(chosen, "repo_id", "left_anti")
    return none.select("repo_id", F.lit("W001").alias("code"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("no framework was found").alias("message"))


@dataclass
class Generated:
    """Tables of all services: what phase two makes."""

    documents: DataFrame
    gates: DataFrame
    errors: DataFrame
    services: DataFrame
    overall: DataFrame
    metadata: DataFrame
    overviews: DataFrame


def generate(found: Analysis) -> Generated:
    """Documents of the services, what is wrong with them, and how ready they are."""
    s = found.settings
    internal = s.document.internal_path_prefixes
    public = cut(found.operations.where(~paths.is_internal(F.col("path"), internal)))
    told = public.withColumn("summary", F.coalesce("summary", enrichment.summary(F.col("method"), F.col("path"), F.col("function"))))
    documents = cut(contracts.assemble(told, found.parts, s.document.conventional_responses, s.document.servers))
    sure = public.where("NOT duplicate").select(*KEY) if s.validation.strict else None
    gates = cut(validation.gates(documents, public, found.statuses, found.parts["security"], s.document.conventional_responses, sure))
    errors = cut(validation.errors(documents))
    rows = public.join(found.parts["bodies"], KEY, "left")
    least = {k: getattr(s.quality, f"min_{k}") for k in report.LEAST}
    scored = cut(report.scored(report.coverage(rows, gates, None, errors), least, s.quality.max_unresolved))
    return Generated(documents, gates, errors, scored, report.overall(scored), metadata.documents(found.operations, found.statuses, found.parts["security"], found.warnings), enrichment.overviews(public))


def commit_of(folder: str | Path) -> str | None:
    """The commit that a working tree stands at; None without one."""
    try:
        said = subprocess.run(["git", "-C", str(folder), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False).stdout.strip()
    except (OSError, subprocess.TimeoutExpired):
        return None
    return said if len(said) == 40 and set(said) <= set("0123456789abcdef") else None


def run(spark: SparkSession, settings: Settings, repo_id: str | None = None) -> tuple[Generated, dict]:
    """Reads the tree at the settings' root, writes documents, metadata and the report, and returns what was made with the files' places."""
    files = cut(tree.files(spark, settings.root, repo_id, settings.analysis.exclude_dirs, settings.analysis.include_migrations))
    made = generate(analyze(files, settings))
    out = Path(settings.output.openapi_path)
    base = out.stem + (".yaml" if settings.output.format == "yaml" else ".json")
    n = sinks.write_documents(made.documents, str(out.parent.resolve()), base)
    for r in made.metadata.toLocalIterator():
        sinks.write_text(Path(settings.output.metadata_path).parent / r["repo_id"] / Path(settings.output.metadata_path).name, r["metadata"])
    path = sinks.write_reports(made.services, made.overall, settings.output.report_path)
    return made, {"documents": n, "report": str(path), "commit": commit_of(settings.root)}
