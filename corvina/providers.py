"""Texts from a provider: calls with growing pauses, stored answers, a breaker after failures in a row, and derived texts where there is none.

A provider is any callable from a prompt to a text; the package ships none, as each needs a client library of its own: register() names them. Operations of a service are asked for one after the other, since the breaker counts failures in a row; services are independent rows and are dealt out.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Iterable
from pathlib import Path

BREAKER, SEPARATOR, VERSION = 5, "\x1f", "1"
FIELDS = ("summary", "description", "tags", "responses", "parameters")
_known: dict[str, Callable] = {}
log = logging.getLogger("corvina.providers")


class ProviderError(RuntimeError):
    """A provider gave no usable answer."""


def register(name: str, make: Callable[..., Callable[[str], str]]) -> None:
    """Names a provider: make(model, api_key, timeout) returns a callable from a prompt to a text."""
    _known[name] = make


def provider(name: str, model: str | None = None, api_key: str | None = None, timeout: int = 60) -> Callable[[str], str] | None:
    """The provider of that name; None for "none"."""
    if name == "none":
        return None
    if not api_key or api_key.startswith("your-"):
        raise ProviderError(f"no usable key for {name}")
    if name not in _known:
        log.warning("no provider %s is registered; texts are derived", name)
        return None
    return _known[name](model, api_key, timeout)


def retried(call: Callable[[str], str], attempts: int = 3, least: float = 1, most: float = 30, sleep: Callable = time.sleep) -> Callable[[str], str]:
    """A call that is tried again after pauses that double."""

    def run(prompt: str) -> str:
        for k in range(max(1, attempts)):
            try:
                text = call(prompt)
                if text:
                    return text
                raise ProviderError("an empty answer")
            except Exception as e:
                if k + 1 >= max(1, attempts):
                    raise ProviderError(f"{type(e).__name__}: {str(e)[:200]}") from e
                sleep(min(most, least * 2**k))
        raise AssertionError

    return run


def unfenced(text: str) -> str:
    """A text without the fence of a code block around it."""
    text = text.strip()
    if text.startswith("```"):
        text = text.partition("\n")[2].removesuffix("```")
    return text.strip()


class Cache:
    """Answers by a key of provider, model, version and payload, one file each; without a folder nothing is kept."""

    def __init__(self, folder: str | Path | None):
        self.folder = Path(folder) if folder else None

    @staticmethod
    def key(name: str, model: str, payload: str) -> str:
        return hashlib.sha256(SEPARATOR.join([name, model, VERSION, payload]).encode()).hexdigest()

    def get(self, key: str) -> str | None:
        path = self.folder and self.folder / f"{key}.txt"
        try:
            return path.read_text(encoding="utf-8") if path else None
        except OSError:
            return None

    def put(self, key: str, text: str) -> None:
        if self.folder:
            from .plans.sinks import write_text

            write_text(self.folder / f"{key}.txt", text)


def payload(operation: dict) -> str:
    """What a provider learns of an operation: facts, never sources."""
    keep = ("method", "path", "summary", "parameters", "statuses", "tags", "secured")
    return json.dumps({k: operation[k] for k in keep if operation.get(k)}, sort_keys=True)


def prompt(operation: dict) -> str:
    return f"Describe this HTTP operation for those who call it, as a JSON object with {', '.join(FIELDS)}. Name nothing that the facts do not name.\n{payload(operation)}"


def answer(text: str) -> dict:
    """An answer's fields; anything else is an error."""
    found = json.loads(unfenced(text))
    if not isinstance(found, dict):
        raise ProviderError("an answer that is no object")
    out = {k: found.get(k) for k in FIELDS}
    if not all(v is None or isinstance(v, {"tags": list, "responses": dict, "parameters": dict}.get(k, str)) for k, v in out.items()):
        raise ProviderError("an answer with fields of other types")
    return out


def enriched(operations: Iterable[dict], call: Callable[[str], str] | None, name: str = "none", model: str = "", cache: Cache | None = None, accept: Callable[[dict, dict], str | None] = lambda operation, texts: None) -> tuple[list[dict], int]:
    """(operations with `texts`, failures): given texts where they are accepted, with derived ones (the operation's own `derived`) under them; after BREAKER failures in a row nothing more is asked."""
    out, failures, row, cache = [], 0, 0, cache or Cache(None)
    for op in operations:
        texts = dict(op.get("derived") or {})
        if call is not None and row < BREAKER:
            key = Cache.key(name, model, payload(op))
            try:
                held = cache.get(key)
                raw = held if held is not None else call(prompt(op))
                found = answer(raw)
                if held is None:
                    cache.put(key, raw)
                row = 0
                if (why := accept(op, found)) is None:
                    texts = merged(texts, found)
                else:
                    log.warning("a text was refused: %s", why)
            except (ProviderError, ValueError) as e:
                failures, row = failures + 1, row + 1
                log.warning("no text: %s", e)
        out.append({**op, "texts": texts})
    return out, failures


def merged(derived: dict, given: dict) -> dict:
    """Given texts over derived ones; descriptions of answers one by one."""
    out = derived | {k: v for k, v in given.items() if v}
    out["responses"] = (derived.get("responses") or {}) | (given.get("responses") or {})
    return out
