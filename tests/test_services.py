"""Own fixture repositories through the whole plan."""

import json

import pytest

from corvina.functions.python_facts import facts
from corvina.plans import services
from corvina.sources import tree

SHOP = {
    "catalog/catalog/main.py": "from fastapi import FastAPI\nfrom pydantic import BaseModel\napp = FastAPI(title='Catalog')\nclass Product(BaseModel):\n    sku: str\n@app.get('/products')\ndef products(limit: int = 10):\n    'List products.'\n@app.get('/products/{sku}')\ndef product(sku: str):\n    ...\n",
    "checkout/checkout/main.py": "from fastapi import FastAPI\nfrom .models import Cart\nfrom .sub import pets, deep as d\napp = FastAPI()\n@app.post('/checkout', status_code=201)\ndef checkout(cart: Cart, x_trace: str = Header(None)):\n    ...\n@app.post('/checkout')\ndef again(cart: Cart):\n    ...\napp.include_router(pets.router, prefix='/api')\napp.include_router(d)\n",
    "checkout/checkout/sub/__init__.py": "from .inner import router as deep\n",
    "checkout/checkout/sub/pets.py": "from fastapi import APIRouter\nfrom checkout.sub.inner import router as inner\nrouter = APIRouter(prefix='/pets', tags=['pets'])\n@router.get('/{pet_id:path}/')\nasync def one(pet_id: int):\n    ...\nrouter.include_router(inner, prefix='/in')\n",
    "checkout/checkout/sub/inner.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.delete('/gone')\ndef gone(): ...\n",
    "checkout/checkout/bad.py": "def (:\n",
    "checkout/requirements.txt": "FastAPI==0.1  # web\n-r x\npydantic_core>=2\n",
    "checkout/tests/../node_modules/x.py": "app = FastAPI()\n",
    "pom.xml": "<project xmlns='x'><artifactId>shop</artifactId></project>",
}
FLASK = {"app.py": "from flask import Flask, Blueprint\nbp = Blueprint('b', __name__, url_prefix='/old')\n@bp.route('/items/<int:item_id>', methods=['GET', 'POST'])\ndef items(item_id): ...\napp = Flask(__name__)\napp.register_blueprint(bp, url_prefix='/v2')\n@app.route('/')\ndef root(): ...\n", "pyproject.toml": "[project]\nname='fl'\ndependencies=['Flask>=2']\n"}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(repo, p, len(t), t.encode()) for repo, tree_ in (("shop", SHOP), ("fl", FLASK)) for p, t in tree_.items()]
    return tree.kept(spark.createDataFrame([tuple([r, p, n, bytearray(c)]) for r, p, n, c in rows], tree.FILES).repartition(3)).cache()


def test_operations(spark, files):
    f = facts(files).cache()
    ops = services.operations(f).cache()
    got = {(r["service"], r["path"], r["method"]) for r in ops.where("NOT duplicate").collect()}
    a, b = "catalog/catalog/main.py:app", "checkout/checkout/main.py:app"
    assert got == {(a, "/products", "get"), (a, "/products/{sku}", "get"), (b, "/checkout", "post"), (b, "/api/pets/{pet_id}", "get"), (b, "/api/pets/in/gone", "delete"), ("app.py:app", "/v2/items/{item_id}", "get"), ("app.py:app", "/v2/items/{item_id}", "post"), ("app.py:app", "/", "get")}
    by = {(r["path"], r["method"]): r for r in ops.where("NOT duplicate").collect()}
    assert [(p["name"], p["location"], p["required"]) for p in by["/checkout", "post"]["parameters"]] == [("cart", "body", True), ("x-trace", "header", False)]
    assert by["/checkout", "post"]["statuses"] == ["201", "422"] and by["/api/pets/{pet_id}", "get"]["tags"] == ["pets"]
    assert by["/products/{sku}", "get"]["operation_id"] == "getProductsBySku"
    assert {(r["code"], r["file"]) for r in services.warnings(ops, f).collect()} == {("W005", "checkout/checkout/main.py"), ("W101", "checkout/checkout/bad.py")}
    docs = services.documents(ops)
    one = next(json.loads(r["document"]) for r in docs.collect() if r["service"] == a)
    assert one["openapi"] == "3.1.0" and one["paths"]["/products"]["get"]["summary"] == "List products." and one["paths"]["/products"]["get"]["parameters"] == [{"in": "query", "name": "limit", "required": False, "schema": {"type": "integer"}}]
    checked = services.gates(ops, docs).collect()
    assert len(checked) == 12 and all(r["passed"] for r in checked)


def test_sources(spark, files, tmp_path):
    found = {(r["repo_id"], r["path"]): r for r in tree.manifests(files).collect()}
    assert found["shop", "checkout/requirements.txt"]["deps"] == {"fastapi": "==0.1", "pydantic-core": ">=2"}
    assert found["fl", "pyproject.toml"]["name"] == "fl" and found["fl", "pyproject.toml"]["deps"] == {"flask": ">=2"}
    assert {tuple(r) for r in tree.import_signals(files, ["fastapi", "flask"]).collect()} == {("shop", "fastapi"), ("fl", "flask")}
    for p, t in FLASK.items():
        (tmp_path / "fl").mkdir(exist_ok=True)
        (tmp_path / "fl" / p).write_text(t)
    assert {(r["repo_id"], r["path"]) for r in tree.files(spark, str(tmp_path)).collect()} == {("fl", "app.py"), ("fl", "pyproject.toml")}
    assert {(r["ext"], r["n"]) for r in tree.extension_counts(files.where("repo_id = 'fl'")).collect()} == {(".py", 1), (".toml", 1)}
