"""Settings in layers: the command line before a YAML file before the environment before defaults; an empty value never hides one below it."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

from .functions.yaml_text import load

PROVIDERS = ("gemini", "anthropic", "openai", "none")


@dataclass
class Output:
    openapi_path: str = "output/openapi.yaml"
    metadata_path: str = "output/metadata.json"
    report_path: str = "output/report.json"
    format: str = "yaml"


@dataclass
class Analysis:
    language: str | None = None
    frameworks: list = field(default_factory=list)
    services: list = field(default_factory=list)
    exclude_dirs: list = field(default_factory=list)
    include_migrations: bool = False


@dataclass
class Texts:
    provider: str = "none"
    model: str | None = None
    api_key: str | None = None
    timeout_seconds: int = 60
    max_retries: int = 3
    cache_dir: str | None = ".text_cache"


@dataclass
class Document:
    title: str | None = None
    version: str = "0.1.0"
    servers: list = field(default_factory=lambda: [{"url": "http://localhost:8080"}])
    internal_path_prefixes: list = field(default_factory=lambda: ["/internal", "/actuator"])
    conventional_responses: bool = False


@dataclass
class Validation:
    strict: bool = False


@dataclass
class Quality:
    min_response_completeness: float = 0.75
    min_request_completeness: float = 0.75
    min_parameter_completeness: float = 0.90
    max_unresolved: int = 0
    fail_on_not_production: bool = False


@dataclass
class Serve:
    port: int = 8081


@dataclass
class Settings:
    root: str = "."
    output: Output = field(default_factory=Output)
    analysis: Analysis = field(default_factory=Analysis)
    texts: Texts = field(default_factory=Texts)
    document: Document = field(default_factory=Document)
    validation: Validation = field(default_factory=Validation)
    quality: Quality = field(default_factory=Quality)
    serve: Serve = field(default_factory=Serve)


#: Environment variables by the setting that they give.
ENVIRONMENT = {"CORVINA_ROOT": "root", "CORVINA_FORMAT": "output.format", "CORVINA_PROVIDER": "texts.provider", "CORVINA_MODEL": "texts.model", "CORVINA_API_KEY": "texts.api_key", "CORVINA_STRICT": "validation.strict", "CORVINA_PORT": "serve.port"}


def merged(below: dict, above: dict) -> dict:
    """Two layers as one: `above` wins, block by block, where it says something."""
    out = dict(below)
    for k, v in above.items():
        if v is not None:
            out[k] = merged(out[k] if isinstance(out.get(k), dict) else {}, v) if isinstance(v, dict) else v
    return out


def from_file(path: str | Path) -> dict:
    found = load(Path(path).read_text(encoding="utf-8"))
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: settings must be a mapping")
    return found


def from_environment(values: dict | None = None) -> dict:
    values, out = os.environ if values is None else values, {}
    for name, place in ENVIRONMENT.items():
        if values.get(name):
            block, _, key = place.rpartition(".")
            (out.setdefault(block, {}) if block else out)[key] = values[name]
    return out


def _typed(value, kind: str, name: str):
    if value is None or not isinstance(value, str):
        ok = {"bool": bool, "int": int, "float": (int, float), "list": list, "str": str}.get(kind.partition(" ")[0])
        if value is not None and ok and (not isinstance(value, ok) or isinstance(value, bool) and kind != "bool"):
            raise ValueError(f"{name}: {value!r} is no {kind}")
        return value
    if kind == "bool":
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{name}: {value!r} is no truth value")
        return value.lower() in ("true", "1", "yes")
    if kind in ("int", "float"):
        return {"int": int, "float": float}[kind](value)
    return [x.strip() for x in value.split(",") if x.strip()] if kind == "list" else value


def _filled(cls, values: dict, at: str):
    known = {f.name: f for f in fields(cls)}
    if unknown := sorted(values.keys() - known.keys()):
        raise ValueError(f"unknown settings: {', '.join(at + u for u in unknown)}")
    out = cls()
    for k, v in values.items():
        inner = getattr(out, k)
        if is_dataclass(inner) and not isinstance(v, dict):
            raise ValueError(f"{at}{k} must be a mapping")
        setattr(out, k, _filled(type(inner), v, f"{at}{k}.") if is_dataclass(inner) else _typed(v, known[k].type, at + k))
    return out


def settings(command_line: dict | None = None, file: str | Path | None = None, environment: dict | None = None) -> Settings:
    layers = merged(merged(from_environment(environment), from_file(file) if file else {}), command_line or {})
    out = _filled(Settings, layers, "")
    if out.output.format not in ("yaml", "json"):
        raise ValueError("output.format must be yaml or json")
    if out.analysis.language not in (None, "python", "java"):
        raise ValueError("analysis.language must be python or java")
    if out.texts.provider not in PROVIDERS:
        out.texts.provider = PROVIDERS[0]
    return out


def shown(settings: Settings) -> dict:
    """Settings without what must not be shown."""
    out = asdict(settings)
    out["texts"]["api_key"] = "***" if out["texts"]["api_key"] else None
    return out
