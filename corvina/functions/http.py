"""Statuses, methods, media types and patterns of HTTP interfaces, as column functions."""

from __future__ import annotations

import http as standard

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of methods in documents, the phrases of classes of statuses, and what keys of responses look like.
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
CLASSES = {"2": "Success", "3": "Redirection", "4": "Client error", "5": "Server error"}
RESPONSE_KEY = r"^([1-5]\d{2}|[1-5]XX|default)$"
# Media types by the names of their constants.
MEDIA = {"APPLICATION_JSON": "application/json", "APPLICATION_XML": "application/xml", "TEXT_PLAIN": "text/plain", "TEXT_HTML": "text/html", "TEXT_EVENT_STREAM": "text/event-stream", "APPLICATION_OCTET_STREAM": "application/octet-stream", "MULTIPART_FORM_DATA": "multipart/form-data", "APPLICATION_NDJSON": "application/x-ndjson", "APPLICATION_FORM_URLENCODED": "application/x-www-form-urlencoded"}


def _mapped(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def status_phrase(status: Column) -> Column:
    """The name of a status, a class of statuses (4XX) or "default"."""
    known = {str(s.value): s.phrase for s in standard.HTTPStatus}
    of_class = F.when(status.rlike("^.XX$"), _mapped(CLASSES, F.substring(status, 1, 1)))
    return F.when(status == "default", "Unexpected error").otherwise(F.coalesce(of_class, _mapped(known, status), F.lit("Response")))


def status_rank(status: Column) -> Column:
    """Numbers in order, all else after them."""
    return F.coalesce(F.when(status.rlike("^[0-9]{1,9}$"), status.cast("int")), F.lit(1000))


def method_rank(method: Column) -> Column:
    """The place of a method in documents, from 0; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, METHODS)), F.lower(method)).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(METHODS))


def is_response_key(key: Column) -> Column:
    return key.rlike(RESPONSE_KEY)


def server_matches(server: Column, common: Column) -> Column:
    """Whether one of two paths begins with the other, segment by segment."""
    s, c = F.trim(F.concat(F.lit(""), server), F.lit("/")), F.trim(F.concat(F.lit(""), common), F.lit("/"))
    return (s != "") & (c != "") & ((s == c) | F.startswith(c, F.concat(s, F.lit("/"))) | F.startswith(s, F.concat(c, F.lit("/"))))


def anchored(pattern: Column) -> Column:
    """A pattern that matches whole values only."""
    open_ = F.when(F.startswith(pattern, F.lit("^")), pattern).when(F.endswith(pattern, F.lit("$")), F.concat(F.lit("^"), pattern)).otherwise(F.concat(F.lit("^(?:"), pattern, F.lit(")")))
    return F.when(F.endswith(open_, F.lit("$")), open_).otherwise(F.concat(open_, F.lit("$")))


def ant_pattern(pattern: Column) -> Column:
    """The regular expression of a path pattern with ?, * and **; a pattern that ends in /** also matches the path before it."""
    plain = F.regexp_replace(pattern, r"([.+(){}\[\]^$|\\])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(plain, r"\*\*", "\x01"), r"\*", "[^/]*")
    every = F.regexp_replace(F.regexp_replace(marked, r"\?", "[^/]"), "/\x01$", "\x02")
    every = F.regexp_replace(F.regexp_replace(every, "\x01", ".*"), "\x02", "(?:/.*)?")
    return F.concat(F.lit("^"), every, F.lit("$"))


def media_type(name: Column) -> Column:
    """What a constant's name, or a literal with a slash, means; JSON for anything else."""
    last = F.regexp_replace(F.element_at(F.split(F.trim(name, F.lit(' "')), "\\."), -1), "_VALUE$", "")
    return F.coalesce(_mapped(MEDIA, last), F.when(name.contains("/"), F.trim(name, F.lit(' "'))), F.lit("application/json"))


def number_of(text: Column, kind: str) -> Column:
    """The number that a text states, null for all else."""
    plain = F.trim(F.trim(text), F.lit('"'))
    return F.when(plain.rlike(r"^[+-]?[0-9]{1,18}$" if kind in ("int", "bigint") else r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast(kind))


def coerced(text: Column, type_: Column) -> Column:
    """A default as JSON of its schema's type; a text that is none of it stays a string."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    return F.coalesce(F.when(type_ == "integer", number_of(text, "bigint").cast("string")).when(type_ == "number", F.when(number_of(text, "double").isNotNull(), F.trim(text))).when((type_ == "boolean") & F.lower(text).isin("true", "false"), F.lower(text)), quoted)


def component_name(title: Column) -> Column:
    """A title as the name of a component."""
    safe = F.regexp_replace(title, r"[^\p{L}\p{N}._-]", "_")
    return F.when(F.coalesce(safe, F.lit("")) == "", "Schema").otherwise(safe)


def unfenced(text: Column) -> Column:
    """A text without the fence of a code block around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
