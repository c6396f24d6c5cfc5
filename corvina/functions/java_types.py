"""Declared types of Java sources, and what their texts say about contracts.

declarations() reads a source with the tokenizer of java_facts and never stops at errors: one value for each class, interface, enum, record and annotation type, nested ones as Outer.Inner. The other functions turn type texts and bodies into schemas, statuses and rules.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.schemas import REF
from .java_facts import TOKEN

SCHEMA = "repo_id string, path string, line int, value string"
FORMS = ("class", "interface", "enum", "record")
# Modifiers of declarations.
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "default", "synchronized", "native", "transient", "volatile", "strictfp", "sealed", "non-sealed"}
# What plain types are in documents.
PLAIN = {
    "void": {}, "Void": {}, "Object": {}, "JsonNode": {}, "ObjectNode": {"type": "object"},
    "String": {"type": "string"}, "CharSequence": {"type": "string"}, "char": {"type": "string"}, "Character": {"type": "string"}, "Locale": {"type": "string"},
    "int": {"type": "integer", "format": "int32"}, "Integer": {"type": "integer", "format": "int32"}, "long": {"type": "integer", "format": "int64"}, "Long": {"type": "integer", "format": "int64"},
    "short": {"type": "integer"}, "Short": {"type": "integer"}, "byte": {"type": "integer"}, "Byte": {"type": "integer"}, "BigInteger": {"type": "integer"},
    "double": {"type": "number", "format": "double"}, "Double": {"type": "number", "format": "double"}, "float": {"type": "number", "format": "float"}, "Float": {"type": "number", "format": "float"}, "BigDecimal": {"type": "number"},
    "boolean": {"type": "boolean"}, "Boolean": {"type": "boolean"}, "UUID": {"type": "string", "format": "uuid"}, "URI": {"type": "string", "format": "uri"}, "URL": {"type": "string", "format": "uri"},
    "LocalDate": {"type": "string", "format": "date"}, "LocalTime": {"type": "string", "format": "time"}, "Duration": {"type": "string", "format": "duration"},
    "LocalDateTime": {"type": "string", "format": "date-time"}, "OffsetDateTime": {"type": "string", "format": "date-time"}, "ZonedDateTime": {"type": "string", "format": "date-time"}, "Instant": {"type": "string", "format": "date-time"}, "Date": {"type": "string", "format": "date-time"},
    "MultipartFile": {"type": "string", "format": "binary"}, "FilePart": {"type": "string", "format": "binary"}, "Resource": {"type": "string", "format": "binary"}, "InputStreamResource": {"type": "string", "format": "binary"}, "ByteArrayResource": {"type": "string", "format": "binary"}, "StreamingResponseBody": {"type": "string", "format": "binary"},
}
# Containers by what they hold.
SEQUENCES = {"List", "Set", "Collection", "Iterable", "ArrayList", "LinkedList", "HashSet", "SortedSet", "Flux", "Stream"}
DISTINCT = {"Set", "HashSet", "SortedSet"}
WRAPPERS = {"ResponseEntity", "HttpEntity", "Mono", "CompletableFuture", "CompletionStage", "Callable", "DeferredResult", "Optional"}
MAPS = {"Map", "HashMap", "TreeMap", "SortedMap", "LinkedHashMap", "MultiValueMap"}
PAGES = {"Page", "Slice"}
ROOTS = {"Object", "Exception", "RuntimeException", "Throwable"}
# Statuses by the names that sources give them.
STATUSES = {"CONTINUE": 100, "OK": 200, "CREATED": 201, "ACCEPTED": 202, "NO_CONTENT": 204, "MOVED_PERMANENTLY": 301, "FOUND": 302, "SEE_OTHER": 303, "NOT_MODIFIED": 304, "TEMPORARY_REDIRECT": 307, "PERMANENT_REDIRECT": 308, "BAD_REQUEST": 400, "UNAUTHORIZED": 401, "PAYMENT_REQUIRED": 402, "FORBIDDEN": 403, "NOT_FOUND": 404, "METHOD_NOT_ALLOWED": 405, "NOT_ACCEPTABLE": 406, "CONFLICT": 409, "GONE": 410, "PRECONDITION_FAILED": 412, "PAYLOAD_TOO_LARGE": 413, "UNSUPPORTED_MEDIA_TYPE": 415, "UNPROCESSABLE_ENTITY": 422, "TOO_MANY_REQUESTS": 429, "INTERNAL_SERVER_ERROR": 500, "NOT_IMPLEMENTED": 501, "BAD_GATEWAY": 502, "SERVICE_UNAVAILABLE": 503, "GATEWAY_TIMEOUT": 504}
# Exceptions of the JAX-RS API by status.
WEB_EXCEPTIONS = {"BadRequestException": 400, "NotAuthorizedException": 401, "ForbiddenException": 403, "NotFoundException": 404, "NotAllowedException": 405, "NotAcceptableException": 406, "NotSupportedException": 415, "InternalServerErrorException": 500, "ServiceUnavailableException": 503}
DOC_CHARACTERS = 500
_RANK = {"high": 0, "medium": 1, "low": 2}


@dataclass
class Token:
    text: str
    line: int
    start: int
    end: int
    doc: str | None


def tokens(text: str) -> list[Token]:
    """Tokens without comments; the doc of one is the documentation comment right before it."""
    out, line, at, doc = [], 1, 0, None
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m[0].startswith("/**"):
            doc = m[0]
        elif not m[0].startswith(("//", "/*")):
            out.append(Token(m[0], line, m.start(), m.end(), doc))
            doc = None
    return out


def documentation(comment: str | None) -> str | None:
    """The plain lines of a documentation comment, as one, without its tags."""
    if not comment:
        return None
    lines = [x.strip().lstrip("*").strip() for x in comment[3:-2].split("\n")]
    text = " ".join(x for x in lines if x and not x.startswith("@"))
    return text[:DOC_CHARACTERS] or None


def literal(text: str) -> str:
    """A string literal's value; other texts stay."""
    text = text.strip()
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    kinds = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " ", "0": "\0"}
    return re.sub(r"\\(u+([0-9a-fA-F]{4})|.)", lambda m: chr(int(m[2], 16)) if m[2] else kinds.get(m[1], m[1]), text[1:-1], flags=re.S)


class _Reader:
    """A walk over tokens; `at` is the place of the next one."""

    def __init__(self, text: str):
        self.text, self.t, self.at = text, tokens(text), 0

    def word(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.t[k].text if k < len(self.t) else ""

    def close(self, at: int) -> int:
        """The place of the bracket that closes the one at `at`, or the end."""
        pair = {"(": ")", "{": "}", "[": "]", "<": ">"}
        opens, closes, depth = self.t[at].text, pair[self.t[at].text], 0
        for k in range(at, len(self.t)):
            depth += (self.t[k].text == opens) - (self.t[k].text == closes)
            if not depth:
                return k
        return len(self.t) - 1

    def raw(self, a: int, b: int) -> str:
        """The source of tokens a to b - 1."""
        return self.text[self.t[a].start : self.t[b - 1].end] if a < b else ""

    def joined(self, a: int, b: int) -> str:
        """A type text of tokens a to b - 1, without annotations."""
        return "".join(x.text if x.text not in ("extends", "super") else f" {x.text} " for x in self.t[a:b])

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Stretches between commas outside brackets."""
        out, depth, first = [], 0, a
        for k in range(a, b):
            x = self.t[k].text
            depth += (x in "([{<") - (x in ")]}>")
            if x == "," and not depth:
                out.append((first, k))
                first = k + 1
        return [*out, (first, b)] if first < b else out

    def annotation(self) -> dict:
        line = self.t[self.at].line
        self.at += 1
        name = self.word()
        self.at += 1
        while self.word() == "." and self.at + 1 < len(self.t):
            name = self.word(1)
            self.at += 2
        out = {"name": name, "line": line, "value": None, "arguments": {}}
        if self.word() == "(":
            end = self.close(self.at)
            for a, b in self.parts(self.at + 1, end):
                if b - a > 2 and self.t[a + 1].text == "=":
                    out["arguments"][self.t[a].text] = literal(self.raw(a + 2, b))
                else:
                    out["value"] = literal(self.raw(a, b))
            self.at = end + 1
        return out

    def marks(self) -> tuple[list[dict], list[str], str | None]:
        """Annotations, modifiers and documentation before a declaration."""
        found, modifiers, doc = [], [], self.t[self.at].doc if self.at < len(self.t) else None
        while self.at < len(self.t):
            if self.word() == "@" and self.word(1) != "interface":
                found.append(self.annotation())
            elif self.word() in MODIFIERS:
                modifiers.append(self.word())
                self.at += 1
            elif self.word() == "non" and self.word(1) == "-" and self.word(2) == "sealed":
                self.at += 3
            else:
                break
        return found, modifiers, documentation(doc)

    def parameters(self, a: int, b: int) -> list[dict]:
        out = []
        for x, y in self.parts(a, b):
            self.at = x
            found, _, _ = self.marks()
            if self.at < y - 1:
                out.append({"name": self.t[y - 1].text, "type": self.joined(self.at, y - 1).replace(" ", " "), "annotations": found})
        return out

    def body(self, a: int, b: int) -> dict:
        """What a method's body throws and calls."""
        throws, calls = [], []
        for k in range(a, b):
            x = self.t[k].text
            if x == "throw" and k + 2 < b and self.t[k + 1].text == "new":
                e = k + 2
                while e < b and self.t[e].text not in ("(", ";", "{"):
                    e += 1
                end = self.close(e) if e < b and self.t[e].text == "(" else e
                throws.append({"type": self.joined(k + 2, e), "arguments": self.raw(e + 1, end), "line": self.t[k].line})
            elif x == "(" and k > a and re.match(r"[A-Za-z_$]", self.t[k - 1].text):
                owner = self.t[k - 3].text if k - 3 >= a and self.t[k - 2].text == "." else ""
                if self.t[k - 2].text != "new" if k - 2 >= a else True:
                    calls.append({"owner": owner, "name": self.t[k - 1].text})
        return {"throws": throws, "calls": calls}


def _members(r: _Reader, end: int, value: dict, head: dict, out: list) -> None:
    """Reads the members up to the closing brace at `end` into value."""
    if value["form"] == "enum":
        while r.at < end and r.word() not in (";", "}"):
            r.marks()
            if r.at >= end or r.word() in (";", "}"):
                break
            value["constants"].append(r.word())
            r.at += 1
            while r.at < end and r.word() not in (",", ";"):
                r.at = r.close(r.at) + 1 if r.word() in "({" else r.at + 1
            r.at += r.word() == ","
        r.at += r.word() == ";"
    while r.at < end:
        start = r.at
        found, modifiers, doc = r.marks()
        if r.at >= end:
            break
        if r.word() in FORMS and re.match(r"[A-Za-z_$]", r.word(1)) and r.word(2) != "=" or r.word() == "@" and r.word(1) == "interface":
            _type(r, found, modifiers, doc, head, value["name"], out)
            continue
        if r.word() in ("{", ";"):  # an initializer, or nothing
            r.at = r.close(r.at) + 1 if r.word() == "{" else r.at + 1
            continue
        if r.word() == "<":
            r.at = r.close(r.at) + 1
        # up to what tells a method from a field
        first, k, depth = r.at, r.at, 0
        while k < end:
            x = r.t[k].text
            depth += (x == "<") - (x == ">")
            if depth <= 0 and x in ("(", "=", ";", "{"):
                break
            k += 1
        if k >= end:
            r.at = max(k, start + 1)
            break
        name = r.t[k - 1].text if k > first else ""
        if r.t[k].text == "(":
            close = r.close(k)
            method = {"name": name, "line": r.t[start].line, "returns": r.joined(first, k - 1), "annotations": found, "modifiers": modifiers, "doc": doc, "parameters": r.parameters(k + 1, close), "body": "", "throws": [], "calls": []}
            r.at = close + 1
            while r.at < end and r.word() not in ("{", ";"):
                r.at += 1
            if r.word() == "{":
                stop = r.close(r.at)
                method |= {"body": r.raw(r.at, stop + 1)} | r.body(r.at + 1, stop)
                r.at = stop
            r.at += 1
            value["methods"].append(method)
        elif r.t[k].text == "{":  # a compact constructor of a record
            r.at = r.close(k) + 1
        else:
            if k - 1 > first:
                value["fields"].append({"name": name, "type": r.joined(first, k - 1), "modifiers": modifiers, "annotations": found, "doc": doc})
            while k < end and r.t[k].text != ";":
                k = r.close(k) + 1 if r.t[k].text in "({[" else k + 1
            r.at = k + 1


def _type(r: _Reader, found, modifiers, doc, head: dict, outer: str, out: list) -> None:
    line = r.t[r.at].line
    form = "annotation" if r.word() == "@" else r.word()
    r.at += 2 if form == "annotation" else 1
    name = f"{outer}.{r.word()}" if outer else r.word()
    r.at += 1
    value = {**head, "name": name, "qualified": f"{head['package']}.{name}" if head["package"] else name, "form": form, "line": line, "annotations": found, "modifiers": modifiers, "doc": doc, "parameters": [], "extends": None, "constants": [], "components": [], "fields": [], "methods": []}
    out.append(value)
    if r.word() == "<":
        end = r.close(r.at)
        value["parameters"] = [r.t[a].text for a, _ in r.parts(r.at + 1, end)]
        r.at = end + 1
    if r.word() == "(":
        end = r.close(r.at)
        value["components"] = r.parameters(r.at + 1, end)
        r.at = end + 1
    while r.at < len(r.t) and r.word() != "{":
        if r.word() == "extends" and form == "class":
            first = r.at = r.at + 1
            while r.at < len(r.t) and r.word() not in ("implements", "permits", "{"):
                r.at += 1
            value["extends"] = r.joined(first, r.at)
        else:
            r.at += 1
    if r.at < len(r.t):
        end = r.close(r.at)
        r.at += 1
        _members(r, end, value, head, out)
        r.at = end + 1


def declarations(text: str) -> list[dict]:
    """The declared types of a source, outer ones first."""
    r, out = _Reader(text), []
    head = {"package": "", "imports": [], "wildcards": []}
    while r.at < len(r.t):
        found, modifiers, doc = r.marks()
        if r.at >= len(r.t):
            break
        if r.word() in ("package", "import"):
            what, first = r.word(), r.at + 1
            while r.at < len(r.t) and r.word() != ";":
                r.at += 1
            name = "".join(x.text for x in r.t[first : r.at])
            if what == "package":
                head["package"] = name
            elif not r.t[first].text == "static":
                (head["wildcards"].append(name[:-2]) if name.endswith(".*") else head["imports"].append(name))
            r.at += 1
        elif r.word() in FORMS and re.match(r"[A-Za-z_$]", r.word(1)) or r.word() == "@" and r.word(1) == "interface":
            _type(r, found, modifiers, doc, head, "", out)
        else:
            r.at += 1
    return out


# ---- type texts


def split_generic(text: str) -> tuple[str, list[str]]:
    """A type's base and its arguments."""
    base, at, rest = text.strip().partition("<")
    if not at:
        return base, []
    inner, out, depth, first = rest.rpartition(">")[0], [], 0, 0
    for k, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(inner[first:k].strip())
            first = k + 1
    return base.strip(), [x for x in [*out, inner[first:].strip()] if x]


def unwrapped(text: str, levels: int = 6) -> str:
    """The type within answers and promises of one."""
    for _ in range(levels):
        base, args = split_generic(text)
        if base.rpartition(".")[2] not in WRAPPERS or not args:
            break
        text = args[0]
    return text.strip()


def names_in(text: str) -> list[str]:
    """The names that a type text refers to."""
    return sorted(set(re.findall(r"[A-Za-z_$][\w$.]*", text or "")) - {"extends", "super"})


def pending_id(qualified: str, arguments: list[str]) -> str:
    """The name of a type with its arguments in the registry."""
    inner = [pending_id(*(lambda b, a: (b.lstrip("@"), a))(*split_generic(x))).removeprefix("java.") for x in arguments]
    return re.sub(r"[^A-Za-z0-9_.\-]", "_", "java." + qualified + ("__of__" + "__and__".join(inner) if inner else ""))


class Converter:
    """Schemas of type texts in the context of a type: `known` gives the qualified name of each name that is one, `binding` the texts of type parameters. A text with @ names a type in full."""

    def __init__(self, known: dict[str, str], binding: dict[str, str] | None = None):
        self.known, self.binding = known, binding or {}
        self.level, self.reason = "high", "declared_type"
        self.references: dict[str, tuple[str, list[str]]] = {}

    def worse(self, level: str, reason: str) -> None:
        if _RANK[level] > _RANK[self.level]:
            self.level, self.reason = level, reason

    def full(self, text: str) -> str:
        """A type text with every known name in full."""
        return re.sub(r"@?[A-Za-z_$][\w$.]*", lambda m: m[0] if m[0][0] == "@" else self.binding[m[0]] if m[0] in self.binding else "@" + self.known[m[0]] if m[0] in self.known else m[0], text)

    def convert(self, text: str) -> dict:
        text = re.sub(r"^\?( (extends|super) )?", "", (text or "").strip())
        if not text:
            self.worse("low", "dynamic_type")
            return {}
        for tail in ("[]", "..."):
            if text.endswith(tail):
                inner = text[: -len(tail)].strip()
                return {"type": "string", "format": "binary"} if tail == "[]" and inner in ("byte", "Byte") else {"type": "array", "items": self.convert(inner)}
        if text in self.binding:
            if self.binding[text] == text:
                self.worse("low", "dynamic_type")
                return {}
            return Converter.convert(self, self.binding[text]) if self.binding[text] not in self.binding else {}
        base, args = split_generic(text)
        simple = base.rpartition(".")[2]
        if simple == "Optional" and args:
            return nullable(self.convert(args[0]))
        if simple in WRAPPERS or simple in SEQUENCES:
            if not args:
                self.worse("medium", "dynamic_type")
            inner = self.convert(args[0]) if args else {}
            return inner if simple in WRAPPERS else {"type": "array", "items": inner} | ({"uniqueItems": True} if simple in DISTINCT else {})
        if simple in MAPS:
            return {"type": "object", "additionalProperties": (self.convert(args[1]) if len(args) > 1 else {}) or True}
        if simple in PAGES and args:
            self.worse("medium", "framework_default")
            number = {"type": "integer"}
            return {"type": "object", "properties": {"content": {"type": "array", "items": self.convert(args[0])}, "totalElements": number | {"format": "int64"}, "totalPages": number, "number": number, "size": number}}
        if simple in PLAIN and not args and not base.startswith("@"):
            return dict(PLAIN[simple])
        qualified = base[1:] if base.startswith("@") else self.known.get(base)
        if qualified is None:
            self.worse("low", "unresolved_symbol")
            return {}
        arguments = [self.full(a) for a in args]
        name = pending_id(qualified, arguments)
        self.references[name] = (qualified, arguments)
        return {"$ref": REF + name}


def nullable(schema: dict) -> dict:
    """A schema that allows null."""
    if not schema:
        return schema
    if isinstance(schema.get("type"), str) and set(schema) == {"type"}:
        return {"type": [schema["type"], "null"]}
    return {"anyOf": [schema, {"type": "null"}]}


def anchored(pattern: str) -> str:
    """A pattern that matches whole values."""
    if not pattern.startswith("^"):
        pattern = f"^{pattern}" if pattern.endswith("$") else f"^(?:{pattern})"
    return pattern if pattern.endswith("$") else pattern + "$"


def number(text: str | None, kind=int):
    """The number that a text states, None for all else."""
    plain = literal(text or "").strip()
    try:
        return kind(plain.rstrip("lL") if kind is int else plain)
    except ValueError:
        return None


def argument(annotation: dict, name: str = "value") -> str | None:
    """An argument of an annotation; the unnamed one is called value."""
    return annotation["arguments"].get(name, annotation["value"] if name == "value" else None)


def listed(annotation: dict, name: str = "value") -> list[str]:
    """An argument as a list: what braces hold, or the one value."""
    text = argument(annotation, name)
    if text is None:
        return []
    text = text.strip()
    parts = text[1:-1].split(",") if text.startswith("{") and text.endswith("}") else [text]
    return [literal(x) for x in parts if x.strip()]


def constrain(schema: dict, annotations: list[dict]) -> dict:
    """schema with the limits that validation annotations state; references stay as they are."""
    if "$ref" in schema:
        return schema
    text, array = schema.get("type") == "string", schema.get("type") == "array"
    found: dict = {}
    for a in annotations:
        n = a["name"]
        if n == "Size":
            stated = {side: number(argument(a, side)) for side in ("min", "max")}
            found |= {side + ("Items" if array else "Length"): v for side, v in stated.items() if v is not None}
        elif n in ("Min", "Max", "DecimalMin", "DecimalMax"):
            found["minimum" if n.endswith("Min") else "maximum"] = number(argument(a), float if n.startswith("D") else int)
        elif n in ("Positive", "PositiveOrZero", "Negative", "NegativeOrZero"):
            side = "imum" if n.endswith("Zero") else "Minimum" if n[0] == "P" else "Maximum"
            found[("min" if n[0] == "P" else "max") + side if n.endswith("Zero") else "exclusive" + side] = 0
        elif n == "Pattern" and argument(a, "regexp"):
            found["pattern"] = anchored(argument(a, "regexp"))
        elif n == "Email" and text:
            found["format"] = "email"
        elif n in ("NotBlank", "NotEmpty") and (text or array and n == "NotEmpty"):
            found.setdefault("minItems" if array else "minLength", schema.get("minItems" if array else "minLength", 1))
    return schema | {k: v for k, v in found.items() if v is not None}


def outer_name(annotations: list[dict], name: str) -> str:
    given = next((argument(a) for a in annotations if a["name"] == "JsonProperty"), None)
    return given or name


def required(annotations: list[dict]) -> bool:
    return any(a["name"] in ("NotNull", "NotBlank", "NotEmpty") or a["name"] == "JsonProperty" and argument(a, "required") == "true" for a in annotations)


def class_schema(value: dict, arguments: list[str], known: dict[str, str], parent: dict | None, parent_known: dict[str, str] | None) -> tuple[dict, Converter]:
    """The schema of a declared type with its type arguments, the parent's fields first, and the converter that met its references."""
    binding = dict(zip(value["parameters"], arguments, strict=False)) if arguments else {p: p for p in value["parameters"]}
    c = Converter(known, binding)
    doc = {"description": value["doc"]} if value["doc"] else {}
    if value["form"] == "enum":
        return {"type": "string"} | ({"enum": value["constants"]} if value["constants"] else {}) | doc, c
    if value["parameters"] and not arguments:
        c.worse("low", "dynamic_type")
    properties, needed = {}, set()

    def add(fields: list[dict], c: Converter) -> None:
        for f in fields:
            if {"static", "transient"} & set(f.get("modifiers", [])) or any(a["name"] == "JsonIgnore" for a in f["annotations"]):
                continue
            schema = constrain(c.convert(f["type"]), f["annotations"])
            if f.get("doc") and "$ref" not in schema:
                schema.setdefault("description", f["doc"])
            name = outer_name(f["annotations"], f["name"])
            properties[name] = schema
            needed.update([name] if required(f["annotations"]) else [])

    if parent:
        texts = split_generic(value["extends"])[1]
        above = Converter(parent_known or {}, dict(zip(parent["parameters"], map(c.full, texts), strict=False)))
        add(parent["fields"], above)
        c.references |= above.references
        c.worse(above.level, above.reason)
    elif value["extends"] and split_generic(value["extends"])[0].rpartition(".")[2] not in ROOTS:
        c.worse("medium", "unresolved_symbol")
    add(value["fields"], c)
    if value["form"] == "record":
        add(value["components"], c)
    if not properties:
        c.worse("low", "dynamic_type")
        return {"type": "object", "additionalProperties": True}, c
    return {"type": "object", "properties": properties} | ({"required": sorted(needed)} if needed else {}) | doc, c


# ---- bodies

_BUILT = re.compile(r"(?:ResponseEntity|ServerResponse|Response)\s*\.\s*(ok|created|accepted|noContent)\s*\(")
_NAMED = re.compile(r"\.\s*status\(\s*(?:HttpStatus\.|Response\.Status\.|Status\.)?([A-Z_]+|\d{3})")


def status_of(text: str | None) -> int | None:
    """The status that a name such as HttpStatus.NOT_FOUND, or a number, means."""
    last = (text or "").strip().rpartition(".")[2]
    return int(last) if re.fullmatch(r"[1-5]\d\d", last) else STATUSES.get(last)


def built(body: str) -> tuple[int | None, bool, bool]:
    """(status of success, whether it names a new resource's place, whether it has no content) that a body's builders show."""
    kinds = set(_BUILT.findall(body))
    found = {{"ok": 200, "created": 201, "accepted": 202, "noContent": 204}[k] for k in kinds}
    found |= {s for s in map(status_of, _NAMED.findall(body)) if s and 200 <= s < 300}
    plain = re.search(r"\.\s*build\s*\(\s*\)", body) and not re.search(r"\.\s*(?:body|entity)\s*\(\s*[^)\s]", body)
    empty = 204 in found or bool(plain) and bool(found & {202} or "created" in kinds)
    first = next((s for s in (201, 202, 204) if s in found), min(found, default=None))
    return first, "created" in kinds, empty


_RULE = re.compile(r"\.\s*(?:requestMatchers|antMatchers|mvcMatchers|regexMatchers)\s*\(([^)]*)\)\s*\.\s*(permitAll|denyAll|(?:fullyA|a)uthenticated|has(?:Any)?(?:Role|Authority)|access)\b")
_EVERY = re.compile(r"anyRequest\s*\(\s*\)\s*\.\s*(?:(?:fullyA|a)uthenticated|has(?:Any)?(?:Role|Authority)|access)\s*\(")


def rules(body: str) -> tuple[list[str], list[str], bool]:
    """(patterns of open paths, of guarded ones, whether all others are guarded) of a filter chain."""
    found = [(action, re.findall(r'"([^"]+)"', args)) for args, action in _RULE.findall(body)]
    of = lambda wanted: [p for action, patterns in found for p in patterns if wanted(action)]
    return of(lambda a: a == "permitAll"), of(lambda a: a not in ("permitAll", "denyAll")), bool(_EVERY.search(body))


def scheme(body: str, owner: str) -> tuple[str, dict] | None:
    """(name, scheme) that a filter chain proves."""
    jwt = {"type": "http", "scheme": "bearer", "bearerFormat": "JWT"}
    if ".oauth2ResourceServer(" in body and "jwt" in body:
        return "bearerAuth", jwt
    if ".httpBasic(" in body:
        return "basicAuth", {"type": "http", "scheme": "basic"}
    added = re.search(r"\.addFilter(?:Before|After|At)\s*\(\s*(?:new\s+)?([A-Za-z_]\w*)", body)
    said = f"{added[1]} {owner} {body}".lower() if added else ""
    if re.search("jwt|bearer|token", said):
        return "bearerAuth", jwt if "jwt" in said else {"type": "http", "scheme": "bearer"}
    return None


def ant_pattern(pattern: str) -> str:
    """The regular expression of a path pattern with ?, * and **."""
    if pattern.endswith("/**"):
        return ant_pattern(pattern[:-3]) [:-1] + "(?:/.*)?$"
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in parts) + "$"


# ---- tables


def _declared(batches):
    for b in batches:
        rows = [(repo, path, v["line"], json.dumps(v)) for repo, path, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for v in declarations((raw or b"").decode("utf-8", "replace"))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], ["repo_id", "path", "line", "value"])


def types(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, value JSON): the types that Java files declare."""
    return files.where(F.col("path").endswith(".java")).select("repo_id", "path", "content").mapInArrow(_declared, SCHEMA)
