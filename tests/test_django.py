from corvina.functions.django_facts import facts
from corvina.plans import django_services, services
from corvina.sources import tree

SITE = {
    "shop/settings.py": "ROOT_URLCONF = 'shop.urls'\n",
    "shop/urls.py": "from django.urls import include, path, re_path\nfrom pets import views\nurlpatterns = [path('api/v1/', include('pets.urls')), path('health/', views.health), re_path(r'^year/(?P<year>[0-9]{4})/$', views.Year.as_view())]\n",
    "pets/urls.py": "from django.urls import include, path\nfrom rest_framework.routers import DefaultRouter\nfrom .views import PetViewSet, Stats\nrouter = DefaultRouter()\nrouter.register('pets', PetViewSet)\nurlpatterns = [path('', include(router.urls)), path('stats/<int:n>/', Stats.as_view()), path('again/', include('shop.urls'))]\n",
    "pets/views.py": "from rest_framework import viewsets\nclass PetViewSet(viewsets.ModelViewSet):\n    @action(detail=True, methods=['post'])\n    def adopt(self, request, pk=None): ...\nclass Stats(APIView):\n    def get(self, request, n): ...\n    def post(self, request, n): ...\nclass Year(ListAPIView):\n    pass\n@api_view(['GET', 'PUT'])\ndef health(request): ...\n",
}


def test_operations(spark):
    files = spark.createDataFrame([("r", p, len(t), bytearray(t.encode())) for p, t in SITE.items()], tree.FILES)
    ops = django_services.operations(facts(files).cache()).cache()
    got = {(r["path"], r["method"]) for r in ops.collect()}
    pets = {("/api/v1/pets/", "get"), ("/api/v1/pets/", "post"), *(("/api/v1/pets/{pk}/", m) for m in ("get", "put", "patch", "delete")), ("/api/v1/pets/{pk}/adopt/", "post")}
    assert got == pets | {("/api/v1/stats/{n}/", "get"), ("/api/v1/stats/{n}/", "post"), ("/health/", "get"), ("/health/", "put"), ("/year/{year}/", "get")}
    assert {r["service"] for r in ops.collect()} == {"shop"}
    by = {(r["path"], r["method"]): r["statuses"] for r in ops.collect()}
    assert by["/api/v1/pets/", "post"] == ["201"] and by["/api/v1/pets/{pk}/", "delete"] == ["204", "404"]
    assert all(r["passed"] for r in services.gates(ops, services.documents(ops)).collect())
