"""YAML texts as plain values, where a reader is installed."""

from __future__ import annotations

try:
    import yaml
except ImportError:  # an optional package
    yaml = None


def load(text: str):
    """The value of a text; None for one that is not YAML."""
    if yaml is None:
        raise RuntimeError("reading YAML needs the package PyYAML")
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


def dump(value) -> str:
    """A text with the keys in their order and without wrapped lines."""
    if yaml is None:
        raise RuntimeError("writing YAML needs the package PyYAML")
    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True, width=100_000)
