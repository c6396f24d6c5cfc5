"""Class schemas, errors along calls, security and whole documents of an own fixture."""

import json

import pytest

from corvina.functions import python_facts, python_types
from corvina.plans import contracts, services
from corvina.sources import tree

ZOO = {
    "zoo/main.py": """
from fastapi import FastAPI, Depends, HTTPException, Security
from zoo.api import Animal, AnimalIn
from .auth import user
from .errors import Gone
from . import keep
app = FastAPI()
@app.exception_handler(Gone)
def on_gone(request, exc):
    return JSONResponse(status_code=410, content={})
@app.get('/animals/{animal_id}', response_model=Animal)
def one(animal_id: int):
    'One animal.'
    return keep.find(animal_id)
@app.post('/animals', status_code=201)
def add(animal: AnimalIn, who=Depends(user)) -> Animal:
    if animal.name == '"':
        raise HTTPException(status_code=409, detail='A "name" twice')
@app.get('/plain')
def plain() -> dict[str, int]: ...
""",
    "zoo/api/__init__.py": "from .models import Animal, AnimalIn\n",
    "zoo/api/models.py": """
from enum import Enum
from typing import Optional, Literal
from pydantic import BaseModel, Field
from datetime import datetime
class Size(str, Enum):
    small = 'small'
    large = 'large'
class Base(BaseModel):
    name: str = Field(..., min_length=1, max_length=9)
class AnimalIn(Base):
    size: Size = Size.small
    legs: Optional[int] = Field(None, ge=0)
class Animal(AnimalIn):
    id: int
    parent: 'Animal | None' = None
    seen: list[datetime] = []
    kind: Literal['a', 'b'] = Field('a', alias='animalKind')
    other: Unknown
class Lonely(BaseModel):
    x: int
""",
    "zoo/auth.py": "from fastapi.security import APIKeyHeader, HTTPDigest\nkey = APIKeyHeader(name='X-Key')\nbad = APIKeyHeader()\ndef user(k=Security(key), b=Depends(bad)):\n    raise HTTPException(status.HTTP_401_UNAUTHORIZED)\n",
    "zoo/errors.py": "class Gone(Exception): ...\n",
    "zoo/keep.py": "from .errors import Gone\nfrom fastapi import HTTPException\ndef find(i):\n    deeper(i)\n    raise HTTPException(404, detail='none')\ndef deeper(i):\n    find(i)\n    raise Gone()\n",
    "zoo/bad.py": "def (:\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("zoo", p, len(t), bytearray(t.encode())) for p, t in ZOO.items()], tree.FILES)
    ops = services.operations(python_facts.facts(files)).cache()
    return ops, python_types.facts(files).cache()


def test_errors_and_security(found):
    ops, facts = found
    assert {(r["path"], r["method"], r["status"], r["detail"], r["confidence"]) for r in contracts.errors(ops, facts).collect()} == {
        ("/animals/{animal_id}", "get", "404", "none", "medium"), ("/animals/{animal_id}", "get", "410", None, "medium"),
        ("/animals", "post", "409", 'A "name" twice', "high"), ("/animals", "post", "401", None, "medium")}
    assert [(r["path"], r["scheme_name"], json.loads(r["scheme"])) for r in contracts.security(ops, facts).collect()] == [("/animals", "key", {"type": "apiKey", "in": "header", "name": "X-Key"})]


def test_schemas(found):
    got = {r["title"]: json.loads(r["schema"]) for r in contracts.schemas(found[1]).collect()}
    assert got["Size"] == {"enum": ["small", "large"], "type": "string"}
    animal = got["Animal"]
    assert animal["required"] == ["id", "name", "other"] and list(animal["properties"]) == ["name", "size", "legs", "id", "parent", "seen", "animalKind", "other"]
    ref = "#/schema_registry/schemas/zoo/api/models.py:"
    assert animal["properties"]["parent"] == {"anyOf": [{"$ref": ref + "Animal"}, {"type": "null"}]} and animal["properties"]["size"] == {"$ref": ref + "Size"}
    assert animal["properties"]["legs"] == {"type": ["integer", "null"], "minimum": 0} and animal["properties"]["other"] == {}
    assert animal["properties"]["name"] == {"type": "string", "minLength": 1, "maxLength": 9}


def test_documents(found):
    ops, facts = found
    (row,) = contracts.documents(ops, facts).collect()
    doc = json.loads(row["document"])
    assert set(doc["components"]["schemas"]) == {"Animal", "AnimalIn", "Size"} and doc["components"]["securitySchemes"] == {"key": {"in": "header", "name": "X-Key", "type": "apiKey"}}
    add = doc["paths"]["/animals"]["post"]
    assert add["requestBody"]["content"]["application/json"]["schema"] == {"$ref": "#/components/schemas/AnimalIn"} and add["security"] == [{"key": []}]
    assert set(add["responses"]) == {"201", "401", "409", "422"} and add["responses"]["409"]["description"] == 'A "name" twice'
    assert doc["paths"]["/animals/{animal_id}"]["get"]["responses"]["200"]["content"]["application/json"]["schema"] == {"$ref": "#/components/schemas/Animal"}
    assert doc["paths"]["/plain"]["get"]["responses"]["200"]["content"]["application/json"]["schema"] == {"type": "object", "additionalProperties": {"type": "integer"}}
    assert "schema_registry" not in row["document"]
